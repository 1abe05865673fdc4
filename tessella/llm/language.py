"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter's largest answer in the
window is kept, and a softmax layer names the language. The net is trained in numpy on the driver, on a bounded sample
of labelled windows; its few thousand numbers travel with the tasks. A whole text is cut into windows, and its
prediction is the mean of theirs, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .texts import Slab, byte_set, slabs

WIDTHS = (2, 3, 4)
PER_WIDTH = 8
EMBEDDED = 8
STEP = 189
#: Zeros in front of a text.
LEAD = max(WIDTHS) - 1
#: Bytes of a window: its filters have STEP places.
WINDOW = STEP + LEAD
BLOCK = 64
NONE = "und"
ASCII_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
NOT_ASCII = byte_set((0x80, 0xFF))


def window_stream(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with every document moved to the start of a window, behind zeros, so that no filter sees two documents;
    windows of each document; bytes of each window."""
    size = np.diff(slab.bounds)
    n_windows = -(-(size + LEAD) // STEP)
    ends = np.cumsum(n_windows)
    stream = np.zeros(int(ends[-1]) * STEP + LEAD, np.uint8)
    shift = (ends - n_windows) * STEP + LEAD - slab.bounds[:-1]
    stream[np.arange(len(slab.data)) + np.repeat(shift, size)] = slab.data
    place = np.arange(int(ends[-1])) - np.repeat(ends - n_windows, n_windows)
    return stream, n_windows, np.clip(np.repeat(size, n_windows) + LEAD - place * STEP, 0, STEP) - LEAD * (place == 0)


@dataclass
class ByteNet:
    """embedding (256, e), filters (taps, e, f) with zeros beyond each filter's width, bias (f), out (f, k), base (k)."""

    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def probabilities(self, stream: np.ndarray) -> np.ndarray:
        """Of each window of a stream; blocks of windows keep the numbers in the cache."""
        n = (len(stream) - max(WIDTHS) + 1) // STEP
        table, taps = np.ascontiguousarray(self.embedding.T), len(self.filters)
        flat = np.ascontiguousarray(np.concatenate([f.T for f in self.filters], axis=1))
        kept = np.empty((n, len(self.bias)), np.float32)
        for first in range(0, n, BLOCK):
            last = min(n, first + BLOCK)
            places = (last - first) * STEP
            seen = table[:, stream[first * STEP : last * STEP + taps - 1]]
            columns = np.concatenate([seen[:, k : k + places] for k in range(taps)])
            answers = (flat @ columns).reshape(len(flat), last - first, STEP)
            kept[first:last] = answers.max(axis=2).T
        return softmax(np.maximum(kept + self.bias, 0) @ self.out + self.base)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, labels: list[str], target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11
) -> ByteNet:
    """Adam on the cross entropy of windows (n, WINDOW) of bytes; every label weighs the same."""
    rng = np.random.default_rng(seed)
    taps, f, k = max(WIDTHS), PER_WIDTH * len(WIDTHS), len(labels)
    mask = np.repeat(np.arange(taps)[:, None, None] < np.repeat(WIDTHS, PER_WIDTH), EMBEDDED, axis=1)
    p = [
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        (rng.normal(0, 0.3, (taps, EMBEDDED, f)) * mask).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, k)).astype(np.float32),
        np.zeros(k, np.float32),
    ]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    weight = 1.0 / np.maximum(np.bincount(target, minlength=k), 1)
    weight = (weight[target] / weight[target].mean()).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            data, rows = windows[own], np.arange(len(own))
            seen = p[0][data]
            columns = np.concatenate([seen[:, j : j + STEP] for j in range(taps)], axis=2)
            answers = columns @ p[1].reshape(taps * EMBEDDED, f)
            best = answers.argmax(axis=1)
            kept = np.take_along_axis(answers, best[:, None], axis=1)[:, 0] + p[2]
            active = np.maximum(kept, 0)
            wrong = softmax(active @ p[3] + p[4])
            wrong[rows, target[own]] -= 1
            wrong *= weight[own][:, None] / len(own)
            back = (wrong @ p[3].T) * (kept > 0)
            heard = columns[rows[:, None], best]  # (n, f, taps * e): what each filter answered to
            d_filters = np.einsum("nf,nfc->cf", back, heard).reshape(taps, EMBEDDED, f) * mask
            d_seen = np.einsum("nf,tef->nfte", back, p[1])
            d_embedding = np.zeros_like(p[0])
            np.add.at(d_embedding, data[rows[:, None, None], best[:, :, None] + np.arange(taps)], d_seen)
            step += 1
            for i, d in enumerate((d_embedding, d_filters, back.sum(0), active.T @ wrong, wrong.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                p[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNet(labels, *p)


def _sampler(per_text: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for slab in slabs(batch.column("text")):
                stream, n_windows, _ = window_stream(slab)
                ends = np.cumsum(n_windows)
                for k in range(slab.n):
                    chosen = np.unique(np.linspace(0, n_windows[k] - 1, min(per_text, n_windows[k])).astype(int))
                    places = (ends[k] - n_windows[k] + chosen)[:, None] * STEP + np.arange(WINDOW)
                    blobs.append(stream[places].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("order"), pa.array(blobs, pa.binary())], ["label", "order", "windows"]
            )

    return sampled


def fit(docs: DataFrame, label: str = "lang", per_label: int = 256, per_text: int = 6, seed: int = 11) -> ByteNet | None:
    """Trains on at most ``per_label`` texts of each label and ``per_text`` windows, spread over the text, of each.

    The texts of a label are those with the smallest seeded hashes of doc_id. Rows without label or text, or with an
    empty text, are left out; without rows to learn from there is no net.
    """
    rows = docs.select(
        F.col(label).cast("string").alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("order"), F.col("text").cast("string").alias("text")
    ).where("label is not null and text <> ''")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # languages: few rows
    if not sizes:
        return None
    near = F.lit(False)
    for name, n in sizes.items():  # twice as many as asked for at first, so that few rows are ranked
        part = min(1.0, (2 * per_label + 20) / n)
        near |= (F.col("label") == name) & (F.pmod(F.col("order"), F.lit(1 << 30)) < int(part * (1 << 30)))
    ranked = F.row_number().over(Window.partitionBy("label").orderBy("order", "windows"))
    drawn = (
        rows.where(near)
        .mapInArrow(_sampler(per_text), "label string, order long, windows binary")
        .withColumn("rank", ranked)
        .where(F.col("rank") <= per_label)
        .orderBy("label", "rank")
        .collect()
    )
    labels = sorted(sizes)
    shots = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in drawn]
    target = np.repeat([labels.index(r["label"]) for r in drawn], [len(s) for s in shots])
    return train(np.concatenate(shots), labels, target, seed=seed)


def _has_letter(slab: Slab) -> np.ndarray:
    found = slab.totals(ASCII_LETTER[slab.data]) > 0
    for k in np.flatnonzero(~found & (slab.totals(NOT_ASCII[slab.data]) > 0)):
        text = slab.data[slab.bounds[k] : slab.bounds[k + 1]].tobytes().decode("utf-8", "replace")
        found[k] = any(c.isalpha() for c in text)
    return found


def _predictor(net: ByteNet | None, names: list[str], text_in: str | None = None):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(names)
            for slab in slabs(batch.column(text_in).field("text") if text_in else batch.column("text")):
                best, score = np.zeros(slab.n, int), np.zeros(slab.n)
                letters = _has_letter(slab) & (net is not None)
                if net is not None:
                    stream, n_windows, size = window_stream(slab)
                    share = net.probabilities(stream) * size[:, None]
                    means = np.add.reduceat(share, np.cumsum(n_windows) - n_windows) / np.maximum(np.diff(slab.bounds), 1)[:, None]
                    best = means.argmax(axis=1)
                    score = np.clip(means[np.arange(slab.n), best], 0, 1)
                found = [net.labels[b] if ok else NONE for b, ok in zip(best, letters)]
                own = rest.slice(slab.first, slab.n)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(found, pa.string()), pa.array(np.where(letters, score, 0.0))],
                    [*own.schema.names, "lang_pred", "score"],
                )

    return predicted


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with lang_pred and score instead of text, for whole texts."""
    names = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(
        _predictor(net, names), ", ".join([*fields, "lang_pred string", "score double"])
    )


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def learned_net(docs: DataFrame, per_label: int = 256) -> ByteNet | None:
    """The net of the documents that are not held out."""
    return fit(docs.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text"), per_label=per_label)


def identify_languages(docs: DataFrame, per_label: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    held_out: crc32 of doc_id as text leaves 2 when divided by 4; such documents, and those without doc_id, are not
    learned from. lang_pred: a learned label, ``und`` for null texts, texts without a letter and if nothing can be
    learned; score: the mean probability of that label, 0 for ``und``. Repeated rows get equal results; other columns
    are not looked at; an empty table gives no rows.
    """
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), learned_net(docs, per_label))


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has a letter."""
    for batch in batches:
        for slab in slabs(batch.column("row").field("text")):
            yield batch.slice(slab.first, slab.n).filter(pa.array(_has_letter(slab)))


def _held_out(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """label, lang_pred, score of the labelled rows that are not learned from and whose text has a letter."""
    held = docs.where(remainder(F.col("doc_id"), 4) == 2).select(F.col("lang").cast("string").alias("label"), "text")
    return predict(held.where("label is not null"), net).where(F.col("lang_pred") != NONE)


def dropped_shares(docs: DataFrame, min_score: float = 0.4, per_label: int = 256) -> DataFrame:
    """label, n, n_below, share, lowest: held-out rows of each label, how many score below ``min_score``, the lowest score."""
    below = F.sum((F.col("score") < min_score).cast("long"))
    counts = _held_out(docs, learned_net(docs, per_label)).groupBy("label")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), below.alias("n_below"), F.min("score").alias("lowest"))
    return counts.select("label", "n", "n_below", (F.col("n_below") / F.col("n")).alias("share"), "lowest")


def accepted(docs: DataFrame, min_score: float = 0.4, per_label: int = 256, trust_labels: bool = True) -> DataFrame:
    """The rows of ``docs`` in a language; all columns as they are.

    Texts without a letter go. So do rows without label whose language is named with a score below ``min_score`` and below
    that of every labelled held-out row; labelled rows stay whatever their score, as do all if there is no net. Without
    ``trust_labels`` all rows are judged alike: those with a score below ``min_score`` go.
    """
    whole = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("row"))
    kind = f"row {whole.schema['row'].dataType.simpleString()}"
    net = learned_net(docs, per_label)
    if net is None:
        return whole.mapInArrow(_lettered, kind).select("row.*")
    judged = whole.mapInArrow(_predictor(net, ["row"], "row"), f"{kind}, lang_pred string, score double")
    if trust_labels:
        lowest = _held_out(docs, net).agg(F.min("score")).first()[0]
        sure = F.col("row.lang").isNotNull() | (F.col("score") >= min(min_score, lowest or 0.0))
    else:
        sure = F.col("score") >= min_score
    return judged.where((F.col("lang_pred") != NONE) & sure).select("row.*")
