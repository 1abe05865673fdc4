"""Quality of whole texts by a byte convolutional network.

Bytes are embedded and filters of several widths slide over the text. Chunks of 256 bytes that overlap by 64 cover all of
it; each filter's largest answer in a chunk is kept, and a weighted sum of them says how good the chunk is. A text's
probability is the logistic function of its chunks' mean, lowest and highest sum. Both steps are learned in numpy on the
driver from a bounded sample of labelled texts: the filters from chunks spread over each text, then the last four numbers
from the sums of all chunks of the same texts, every label weighed by its share of all labelled rows. The network's few
thousand numbers travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scope
from .texts import Slab, slabs

WIDTHS = (2, 3, 5)
PER_WIDTH = 8
EMBEDDED = 8
TAPS = max(WIDTHS)
#: Places of a block; a chunk is PER_CHUNK blocks, and the next one begins STEP blocks later.
BLOCK, PER_CHUNK, STEP = 64, 4, 3
#: Blocks whose answers are computed at once.
AT_ONCE = 48


def block_stream(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with zeros before and behind every document, so that no filter sees two of them; chunks of each document.

    A document of k chunks takes STEP * (k - 1) + PER_CHUNK blocks.
    """
    size = np.diff(slab.bounds)
    blocks = -(-(size + TAPS - 1) // BLOCK)
    chunks = 1 + np.maximum(0, -(-(blocks - PER_CHUNK) // STEP))
    upto = np.cumsum(STEP * (chunks - 1) + PER_CHUNK)
    begin = upto - (STEP * (chunks - 1) + PER_CHUNK)
    stream = np.zeros(int(upto[-1]) * BLOCK + TAPS - 1, np.uint8)
    shift = begin * BLOCK + TAPS - 1 - slab.bounds[:-1]
    stream[np.arange(len(slab.data)) + np.repeat(shift, size)] = slab.data
    return stream, chunks


def first_blocks(chunks: np.ndarray) -> np.ndarray:
    """The first block of every chunk."""
    place = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    upto = np.cumsum(STEP * (chunks - 1) + PER_CHUNK)
    return np.repeat(upto - (STEP * (chunks - 1) + PER_CHUNK), chunks) + STEP * place


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityNet:
    """embedding (256, e); filters of each width (width * e, f); bias (all filters); weights and base of a chunk's sum;
    weights of a text's mean, lowest and highest sum, and of one."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    base: float
    combine: np.ndarray

    def chunk_sums(self, stream: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        blocks = (len(stream) - TAPS + 1) // BLOCK
        table = np.ascontiguousarray(self.embedding.T)
        flat = [np.ascontiguousarray(f.T) for f in self.filters]
        most = np.empty((blocks, len(self.bias)), np.float32)
        for first in range(0, blocks, AT_ONCE):
            last = min(blocks, first + AT_ONCE)
            places = (last - first) * BLOCK
            seen = table[:, stream[first * BLOCK : last * BLOCK + TAPS - 1]]
            columns = np.concatenate([seen[:, k : k + places] for k in range(TAPS)])
            for k, (width, f) in enumerate(zip(WIDTHS, flat)):
                answers = (f @ columns[: width * EMBEDDED]).reshape(len(f), last - first, BLOCK)
                most[first:last, k * PER_WIDTH : (k + 1) * PER_WIDTH] = answers.max(axis=2).T
        first = first_blocks(chunks)
        kept = most[first]
        for k in range(1, PER_CHUNK):
            np.maximum(kept, most[first + k], out=kept)
        return (np.maximum(kept + self.bias, 0) @ self.weights + self.base).astype(np.float64)

    def text_sums(self, slab: Slab) -> np.ndarray:
        """Mean, lowest and highest sum of each text's chunks, and one."""
        stream, chunks = block_stream(slab)
        sums = self.chunk_sums(stream, chunks)
        first = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(sums, first) / chunks
        return np.stack([mean, np.minimum.reduceat(sums, first), np.maximum.reduceat(sums, first), np.ones(slab.n)], axis=1)

    def scores(self, slab: Slab) -> np.ndarray:
        return sigmoid(self.text_sums(slab) @ self.combine)


def train(windows: np.ndarray, target: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 23) -> QualityNet:
    """Adam on the log loss of chunks (n, PER_CHUNK * BLOCK + TAPS - 1) of bytes; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    f, places = PER_WIDTH * len(WIDTHS), PER_CHUNK * BLOCK
    p = [rng.normal(0, 0.5, (256, EMBEDDED)), *(rng.normal(0, 0.3, (w * EMBEDDED, PER_WIDTH)) for w in WIDTHS),
         np.zeros(f), rng.normal(0, 0.3, f), np.zeros(1)]
    p = [x.astype(np.float32) for x in p]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    weight = len(target) / 2 / np.maximum(np.bincount(target, minlength=2), 1)[target]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = np.arange(len(own))
            data = windows[own]
            seen = p[0][data]
            columns = np.concatenate([seen[:, k : k + places] for k in range(TAPS)], axis=2)
            answers = [columns[:, :, : w * EMBEDDED] @ x for w, x in zip(WIDTHS, p[1:-3])]
            best = [a.argmax(axis=1) for a in answers]
            kept = np.concatenate([np.take_along_axis(a, b[:, None], axis=1)[:, 0] for a, b in zip(answers, best)], axis=1) + p[-3]
            active = np.maximum(kept, 0)
            wrong = ((sigmoid(active @ p[-2] + p[-1]) - target[own]) * weight[own] / len(own)).astype(np.float32)
            back = wrong[:, None] * p[-2] * (kept > 0)
            d_embedding, d_filters = np.zeros_like(p[0]), []
            for k, (w, x) in enumerate(zip(WIDTHS, p[1:-3])):
                part = back[:, k * PER_WIDTH : (k + 1) * PER_WIDTH]
                heard = columns[rows[:, None], best[k], : w * EMBEDDED]
                d_filters.append(np.einsum("nf,nfc->cf", part, heard))
                d_seen = np.einsum("nf,cf->nfc", part, x).reshape(len(own), PER_WIDTH, w, EMBEDDED)
                np.add.at(d_embedding, data[rows[:, None, None], best[k][:, :, None] + np.arange(w)], d_seen)
            step += 1
            for i, d in enumerate((d_embedding, *d_filters, back.sum(0), active.T @ wrong, wrong.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                p[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityNet(p[0], p[1:-3], p[-3], p[-2], float(p[-1][0]), np.array([1.0, 0, 0, 0]))


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of ``x`` is one and has no penalty."""
    found = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ found)
        slope = x.T @ (weight * (p - target)) + ridge @ found
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        found -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return found


def _sampler(per_text: int):
    size = PER_CHUNK * BLOCK + TAPS - 1

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for slab in slabs(batch.column("text")):
                stream, chunks = block_stream(slab)
                begin = first_blocks(chunks) * BLOCK
                ends = np.cumsum(chunks)
                for k in range(slab.n):
                    chosen = np.unique(np.linspace(0, chunks[k] - 1, min(per_text, chunks[k])).astype(int))
                    blobs.append(stream[begin[ends[k] - chunks[k] + chosen][:, None] + np.arange(size)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("doc_id"), pa.array(blobs, pa.binary())], ["label", "doc_id", "windows"]
            )

    return sampled


def _summer(net: QualityNet):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                own = batch.select(["label", "doc_id"]).slice(slab.first, slab.n)
                sums = pa.array(list(net.text_sums(slab)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*own.columns, sums], ["label", "doc_id", "sums"])

    return summed


def learning_rows(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and label (0 or 1) of the rows of ``labels`` to learn from: crc32 of doc_id leaves no 0 when divided by 5."""
    rows = labels.select("doc_id", (F.col(label) == 1).cast("int").alias("label"))
    return rows.where(~_held_out(F.col("doc_id"))).where("doc_id is not null and label is not null")


def fit(docs: DataFrame, rows: DataFrame, per_label: int = 768, per_text: int = 8, seed: int = 23) -> QualityNet | float:
    """Learns from ``rows`` (doc_id, label 0 or 1) and the texts of ``docs``.

    The sample: the ``per_label`` rows of each label with the smallest seeded hashes of doc_id, and of each text
    ``per_text`` chunks spread over it. Of documents with equal ids the smallest text is taken. Where a label has no text
    there is no net, and the share of label 1 in ``rows`` (one half without rows) is returned.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    order = (F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    chosen = [rows.where(F.col("label") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]).distinct())  # 2 * per_label rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    with scope(docs.sparkSession) as stored:
        texts = stored(texts.groupBy("label", "doc_id").agg(F.min("text").alias("text")), "quality-sample")
        drawn = texts.mapInArrow(_sampler(per_text), f"label int, doc_id {kind}, windows binary").orderBy("label", "doc_id").collect()
        if len({r["label"] for r in drawn}) < 2:
            return share
        shots = [np.frombuffer(r["windows"], np.uint8).reshape(-1, PER_CHUNK * BLOCK + TAPS - 1) for r in drawn]
        target = np.repeat([r["label"] for r in drawn], [len(s) for s in shots])
        net = train(np.concatenate(shots), target, seed=seed)
        summed = texts.mapInArrow(_summer(net), f"label int, doc_id {kind}, sums array<double>").orderBy("label", "doc_id").collect()
    sums, target = np.array([r["sums"] for r in summed]), np.array([r["label"] for r in summed])
    weight = np.array([1 - share, share])[target] * len(target) / np.bincount(target)[target]
    net.combine = logistic(sums, target, weight)
    return net


def _scorer(net: QualityNet | float, names: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                own = batch.select(names).slice(slab.first, slab.n)
                score = np.full(slab.n, net) if isinstance(net, float) else net.scores(slab)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score, pa.float64())], [*names, "score"])

    return scored


def score_quality(docs: DataFrame, net: QualityNet | float) -> DataFrame:
    """``docs`` with score instead of text, for whole texts; null is scored as empty."""
    names = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_scorer(net, names), ", ".join([*fields, "score double"]))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 768) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    held_out: the crc32 of doc_id as text can be divided by 5; labels of such rows are not learned from, nor are rows of
    ``labels`` without doc_id or quality. score: probability of label 1, from the whole text alone, the same for equal
    texts but for rounding in the sixth place. predicted: 1 if it is at least ``threshold``, else 0. Null and empty texts are scored like a text of zero
    bytes. Repeated rows stay and repeated labels count as often as they occur; other columns are not looked at; an empty
    table gives no rows; if nothing can be learned all scores are the share of label 1, or one half.
    """
    net = fit(docs, learning_rows(labels), per_label=per_label)
    found = score_quality(docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text"), net)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
