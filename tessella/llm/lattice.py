"""LM scoring by subword lattice likelihood.

The pieces of an existing subword vocabulary spell a word in many ways. Every way weighs the product of its pieces'
probabilities, and a forward recursion in log space sums over all of them: the marginal probability of the word. The
vocabulary stays as it is; its scores, taken as ranks, give first weights. One pass over the training words counts how
often each piece is expected under them, and those counts, on top of the first weights, are the model. A text is its
words and an end, so the log probabilities of its words and of an end add up to the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, scope
from .chunks import answered, bucket_count, by_bucket, chunk_table, deal, in_order, opened, pack, unpack
from .language import remainder
from .texts import NOT_BLANK, Slab, running_bytes, span_hash

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
#: Bytes of text in a chunk: the larger, the fewer words are spelled in several chunks.
CHUNK = 8 << 20
#: Words' worth of first weights that the expected counts are added to.
PRIOR = 10_000.0
SIEVE = 20
END = "end"


@dataclass
class Pieces:
    """Pieces in the order of their hashes: hash, length in bytes, log weight; hashes of all their beginnings by length."""

    hashes: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    begins: list[np.ndarray]
    end_weight: float = 0.0

    def reweighted(self, expected: np.ndarray, ends: float, prior: float = PRIOR) -> Pieces:
        """Weights from expected counts and the present weights; they and the end's add up to 1."""
        counts = expected + prior * np.exp(self.weights)
        end = ends + prior / len(counts)
        total = counts.sum() + end
        return Pieces(self.hashes, self.sizes, np.log(counts / total), self.begins, float(np.log(end / total)))


def read_pieces(path: str = VOCABULARY) -> Pieces:
    """A sentencepiece vocabulary. First weights follow Zipf's law over the pieces in the order of their scores.

    Every single byte is a piece, so that each text can be spelled; bytes have the lowest rank.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {bytes([b]): -np.inf for b in range(256)}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)) and piece:
            scored[piece.encode()] = max(model.get_score(k), scored.get(piece.encode(), -np.inf))
    names = sorted(scored, key=lambda p: (-scored[p], p))
    weight = 1.0 / (np.arange(len(names)) + 10.0)
    lengths = np.array([len(p) for p in names])
    sums, ends = running_bytes(np.frombuffer(b"".join(names), np.uint8)), np.cumsum(lengths)
    hashes = span_hash(sums, ends - lengths, ends)
    begins = [
        np.unique(span_hash(sums, (ends - lengths)[lengths >= n], (ends - lengths + n)[lengths >= n]))
        for n in range(1, int(lengths.max()) + 1)
    ]
    order = np.argsort(hashes)
    return Pieces(hashes[order], lengths[order], np.log(weight / weight.sum())[order], begins)


class Lattice:
    """All pieces at all places of a list of words, and sums over the ways to spell each word.

    The first bits of a hash name the first piece that could have it; pieces with equal first bits stand in a row. What
    begins no piece is dropped by tables of first bits, which keep a little too much and never too little.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.sieves = [self._sieve(b) for b in pieces.begins]
        top = (pieces.hashes >> np.uint64(64 - SIEVE)).astype(np.int64)
        self.starts = np.searchsorted(top, np.arange((1 << SIEVE) + 1)).astype(np.int32)
        self.in_row = int(np.diff(self.starts).max(initial=0))

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        sieve = np.zeros(1 << SIEVE, bool)
        sieve[hashes >> np.uint64(64 - SIEVE)] = True
        return sieve

    def members(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pieces among hashes, and the pieces' numbers."""
        top = asked >> np.uint64(64 - SIEVE)
        first = self.starts[top]
        place = np.flatnonzero(self.starts[top + np.uint64(1)] > first)
        first, wanted = first[place], asked[place]
        number = np.full(len(place), -1, np.int32)
        for k in range(self.in_row):
            near = np.minimum(first + k, len(self.pieces.hashes) - 1)
            number = np.where(self.pieces.hashes[near] == wanted, near, number)
        return place[number >= 0], number[number >= 0]

    def spell(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Edges:
        """Edges of the words data[start:end], each with the mark of a word's beginning in front."""
        size = end - start + len(SPACE)
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint8)
        flat[np.arange(len(flat)) - np.repeat(first, size) < len(SPACE)] = 0
        inner = np.arange(int((end - start).sum())) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
        flat[np.repeat(first + len(SPACE), end - start) + inner] = data[np.repeat(start, end - start) + inner]
        for k, b in enumerate(SPACE):
            flat[first + k] = b
        sums = running_bytes(flat)
        place = np.arange(len(flat))
        rest = np.repeat(first + size, size) - place  # bytes up to the end of the word
        found = []
        for n in range(1, len(self.sieves) + 1):
            place, rest = place[rest >= n], rest[rest >= n]
            hashes = span_hash(sums, place, place + n)
            kept = self.sieves[n - 1][hashes >> np.uint64(64 - SIEVE)]
            place, rest, hashes = place[kept], rest[kept], hashes[kept]
            if not len(place):
                break
            whole, number = self.members(hashes)
            found.append((place[whole], np.full(len(whole), n), number))
        at, length, number = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        word = np.repeat(np.arange(len(size)), size)[at]
        return Edges(first, size, word, at - first[word], length, number)


@dataclass
class Edges:
    first: np.ndarray
    size: np.ndarray
    word: np.ndarray
    at: np.ndarray
    length: np.ndarray
    number: np.ndarray

    def _grouped(self, key: np.ndarray) -> Iterator[np.ndarray]:
        """Edge numbers by (key, length): in a group no two edges of a word meet the same place."""
        both = key * (int(self.length.max(initial=0)) + 1) + self.length
        if both.max(initial=0) < 1 << 16:
            both = both.astype(np.uint16)  # sorted by digits
        order = np.argsort(both, kind="stable")
        both = both[order]
        cuts = np.flatnonzero(both[1:] != both[:-1]) + 1
        yield from np.split(order, cuts) if len(order) else ()

    def forward(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums up to each place of each word (places of word k begin at first[k] + k), and of whole words."""
        base = self.first + np.arange(len(self.first))
        alpha = np.full(int(self.size.sum()) + len(self.size), -np.inf)
        alpha[base] = 0.0
        origin = base[self.word] + self.at
        target, weight = origin + self.length, weights[self.number]
        for own in self._grouped(self.at + self.length):
            alpha[target[own]] = np.logaddexp(alpha[target[own]], alpha[origin[own]] + weight[own])
        return alpha, alpha[base + self.size]

    def expected(self, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece when word k occurs times[k] times."""
        alpha, whole = self.forward(weights)
        base = self.first + np.arange(len(self.first))
        beta = np.full(len(alpha), -np.inf)
        beta[base + self.size] = 0.0
        origin = base[self.word] + self.at
        target, weight = origin + self.length, weights[self.number]
        for own in self._grouped(int(self.size.max(initial=0)) - self.at):
            beta[origin[own]] = np.logaddexp(beta[origin[own]], beta[target[own]] + weight[own])
        part = np.exp(alpha[origin] + weight + beta[target] - whole[self.word]) * times[self.word]
        return np.bincount(self.number, weights=part, minlength=len(weights))


#: Bytes of words that are spelled at once.
AT_ONCE = 1 << 18


def _in_parts(start: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Slices of words sorted by length, so that long words do not share the steps of short ones."""
    upto = np.cumsum(end - start + len(SPACE))
    cuts = np.searchsorted(upto, np.arange(AT_ONCE, int(upto[-1]) if len(upto) else 0, AT_ONCE)) + 1
    cuts = np.unique(np.concatenate([[0], cuts, [len(start)]]))
    yield from (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:]))


@dataclass
class Vocabulary:
    """Distinct words of a chunk in the order of their hashes, where each stands, and the word of each token."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of_token: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, slab: Slab) -> Vocabulary:
        found = [(at, part.first, part.words(NOT_BLANK)) for at, part in slab.parts()]
        hash_, start, end, doc = (
            np.concatenate([np.zeros(0, x.dtype), *columns])
            for x, *columns in zip(
                (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3),
                *((w.hash, w.start + at, w.end + at, w.doc + first) for at, first, w in found),
            )
        )
        hashes, first, number = np.unique(hash_, return_index=True, return_inverse=True)
        return cls(hashes, start[first], end[first], number, doc)

    def log_probabilities(self, lattice: Lattice, data: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.hashes))
        order = np.argsort(self.end - self.start, kind="stable")
        for part in _in_parts(self.start[order], self.end[order]):
            own = order[part]
            found[own] = lattice.spell(data, self.start[own], self.end[own]).forward(lattice.pieces.weights)[1]
        return found

    def expected(self, lattice: Lattice, data: np.ndarray, times: np.ndarray) -> np.ndarray:
        total = np.zeros(len(lattice.pieces.weights))
        chosen = np.flatnonzero(times)
        order = chosen[np.argsort((self.end - self.start)[chosen], kind="stable")]
        for part in _in_parts(self.start[order], self.end[order]):
            own = order[part]
            total += lattice.spell(data, self.start[own], self.end[own]).expected(lattice.pieces.weights, times[own].astype(float))
        return total


QUESTION = "bucket int, chunk long, hashes binary, counts binary, piece array<int>, expected array<double>, texts long, tokens long"


def _asker(pieces, buckets: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value)
        expected, texts, tokens = np.zeros(len(lattice.pieces.weights)), 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                slab = opened(batch, row, lower_case=True)
                learned = ~np.asarray(batch.column("held_out")[row].as_py(), bool)
                words = Vocabulary.of(slab)
                times = np.bincount(words.of_token[learned[words.doc]], minlength=len(words.hashes))
                expected += words.expected(lattice, slab.data, times)
                texts, tokens = texts + int(learned.sum()), tokens + int(times.sum())
                order, first = deal(words.hashes, buckets)
                own = [k for k in range(buckets) if first[k] < first[k + 1]]
                parts = [order[first[k] : first[k + 1]] for k in own]
                yield _questions(
                    own, batch.column("chunk")[row].as_py(), [words.hashes[p].tobytes() for p in parts], [pack(times[p].astype(np.uint32)) for p in parts]
                )
        found = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
             pa.array([found.astype(np.int32)], pa.list_(pa.int32())), pa.array([expected[found]], pa.list_(pa.float64())),
             pa.array([texts], pa.int64()), pa.array([tokens], pa.int64())],
            ["bucket", "chunk", "hashes", "counts", "piece", "expected", "texts", "tokens"],
        )

    return asked


def _questions(own: list[int], chunk: int, hashes: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()),
         pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        ["bucket", "chunk", "hashes", "counts", "piece", "expected", "texts", "tokens"],
    )


def _total(questions: pa.Table) -> pa.Table:
    """Sums the counts of a bucket's words over the chunks. A row of chunk -1 says how many words were learned."""
    chunks, blobs = questions.column("chunk").to_pylist(), questions.column("hashes").to_pylist()
    parts = [np.frombuffer(b, np.uint64) for b in blobs]
    counts = np.concatenate([unpack(b, np.uint32) for b in questions.column("counts").to_pylist()])
    hashes, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(number, weights=counts, minlength=len(hashes)).astype(np.int64)
    answers, at = [], 0
    for p in parts:
        answers.append(pack(total[number[at : at + len(p)]]))
        at += len(p)
    bucket = questions.column("bucket")[0].as_py()
    return pa.table(
        {
            "chunk": pa.array([*chunks, -1], pa.int64()),
            "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int32()),
            "answer": pa.array([*answers, None], pa.binary()),
            "distinct": pa.array([*[None] * len(chunks), int((total > 0).sum())], pa.int64()),
        }
    )


SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(shared, buckets: int, ends: int, tokens: int, distinct: int):
    def base(count):
        return np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        lattice = Lattice(shared.value)
        slab = opened(chunk, 0, lower_case=True)
        words = Vocabulary.of(slab)
        order, _ = deal(words.hashes, buckets)
        count = np.empty(len(words.hashes), np.int64)
        count[order] = in_order(answers, np.int64)
        model = words.log_probabilities(lattice, slab.data) / np.log(10)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(words.doc, weights=values[words.of_token], minlength=slab.n)

        found = {
            "n_tokens": np.bincount(words.doc, minlength=slab.n) + 1,
            "n_known": (total(count > 0) + (ends > 0)).astype(np.int64),
            "train_tokens": np.full(slab.n, tokens, np.int64),
            "base_score": total(base(count)) + base(ends),
            "score": total(model) + lattice.pieces.end_weight / np.log(10),
        }
        return pa.table({c: chunk.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out")} | found)

    return scored


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Texts are lower-cased (A-Z) and split into words without blanks; an end follows the last word and is a token too.
    held_out: crc32 of doc_id as text leaves 1 when divided by 5; the other documents, also those without doc_id, are
    learned from. n_known: tokens that were learned; base_score: log10 probability under their smoothed counts; score:
    log10 probability of the text under the lattice. A null text is empty: its only token is the end. Repeated rows are
    scored, and learned, each; other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    with scope(spark):
        table = chunk_table(docs.select("doc_id", held_out.alias("held_out"), "text"), "lm-chunks", limit=CHUNK)
        buckets = bucket_count(table)
        pieces = read_pieces(vocabulary)
        asked = materialise(table.mapInArrow(_asker(spark.sparkContext.broadcast(pieces), buckets), QUESTION), "lm-words")
        sums = asked.where("bucket = -1")
        texts, tokens = (int(x or 0) for x in sums.agg(F.sum("texts"), F.sum("tokens")).first())
        paired = sums.select(F.explode(F.arrays_zip("piece", "expected")).alias("x")).select("x.*")
        expected = np.zeros(len(pieces.weights))
        for row in paired.groupBy("piece").agg(F.sum("expected").alias("n")).collect():  # a row for a piece at most
            expected[row["piece"]] = row["n"]
        questions = asked.where("bucket >= 0").select("bucket", "chunk", "hashes", "counts")
        answers = materialise(by_bucket(questions, _total, "chunk long, bucket int, answer binary, distinct long"), "lm-counts")
        distinct = int(answers.where("chunk = -1").agg(F.sum("distinct")).first()[0] or 0) + (texts > 0)
        model = spark.sparkContext.broadcast(pieces.reweighted(expected, texts))
        to_chunks = answers.where("chunk >= 0").select("chunk", "bucket", "answer")
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, {SCORED}"
        return materialise(answered(table, to_chunks, _scorer(model, buckets, texts, tokens + texts, distinct), schema), "lm-scores", keep=True)
