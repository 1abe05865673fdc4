"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over every 32 bytes triggers phrases: the trigger of a string of 100 bytes is its gram with the smallest
hash, so a string has exactly one trigger, at a place that only its own bytes decide, and no text is without triggers as
it would be with a hash modulo a number. Neighbouring strings mostly share a trigger; together they are a phrase, which
overlaps the next one by 99 bytes as prefix-free parsing wants it. Most phrases of a repeated passage occur elsewhere as
a whole: the dictionary keeps each of them once, and the parse of a document is its list of phrases.

Sorted arrays then give the order of the corpus. The parse array tells of every phrase its first occurrence. Where a
gram triggers different phrases, their strings can still meet: only these phrases are taken apart, and the array of
dictionary suffixes, cut at 100 bytes, tells of every such string its first occurrence. Both arrays are sorted by hashes,
bucket by bucket: equal strings are neighbours in that order as they are in the alphabetical one, and nothing else is
asked of it. A string is repeated if its phrase, or itself, occurs earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, scope
from .chunks import answered, bucket_count, by_bucket, chunk_table, deal, in_order, opened, pack, unpack
from .texts import Slab, covered, mix, running_bytes, span_hash

LENGTH = 100
GRAM = 32
#: Low bits of a sort key that hold a place in the text.
PLACE_BITS = 28
NO_ID = (1 << 63) - 1
QUESTION = "bucket int, chunk long, keys binary, extra binary"


@dataclass
class Phrases:
    """Phrases of a chunk in text order: trigger hash, first and last start of their strings, document, own hash."""

    trigger: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    own: np.ndarray


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` values in a row."""
    done = 1
    while 2 * done <= size:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (size - done)], values[size - done :]) if size > done else values


def parse(slab: Slab, sums: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Phrases:
    """Phrases of the strings of ``length`` bytes of each document of a slab."""
    n = len(slab.data)
    if n < length:
        none = np.zeros(0, np.int64)
        return Phrases(none.astype(np.uint64), none, none, none, none.astype(np.uint64))
    place = np.arange(n - gram + 1)
    grams = span_hash(sums, place, place + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _smallest((grams & ~low) | place.astype(np.uint64), length - gram + 1)
    trigger = (least & low).astype(np.int64)
    if n > 1 << PLACE_BITS:  # the place is the only one near the string with these low bits
        start = np.arange(len(trigger))
        trigger = start + ((trigger - start) & int(low))
    whole = np.zeros(len(trigger) + 1, bool)
    change = np.zeros(len(trigger) + 2, np.int64)
    begins, ends = slab.bounds[:-1], slab.bounds[1:] - length + 1
    long = ends > begins
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long], -1)
    whole[:-1] = np.cumsum(change[: len(trigger)]) > 0
    fresh = whole[:-1].copy()
    fresh[1:] &= ~whole[:-2] | (trigger[1:] != trigger[:-1])
    last = whole[:-1].copy()
    last[:-1] &= ~whole[1:-1] | (trigger[1:] != trigger[:-1])
    first, last = np.flatnonzero(fresh), np.flatnonzero(last)
    at = trigger[first]
    own = mix(span_hash(sums, first, last + length) + (at - first).astype(np.uint64))
    return Phrases(grams[at], first, last, np.searchsorted(slab.bounds, first, "right") - 1, own)


class Chunk:
    """A chunk's text, its phrases, and the distinct hashes it asks about."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, row: int):
        self.slab = opened(batch, row)
        self.number = batch.column("chunk")[row].as_py()
        ids = batch.column("order_id")[row].as_py()
        self.order = np.array(ids, np.int64)
        self.sums: list[tuple[int, Slab, np.ndarray]] = []
        found = []
        for at, part in self.slab.parts():
            sums = running_bytes(part.data)
            self.sums.append((at, part, sums))
            p = parse(part, sums)
            found.append((p.trigger, p.first + at, p.last + at, p.doc + part.first, p.own))
        self.phrases = Phrases(*(np.concatenate(x) for x in zip(*found)))
        self.distinct, self.first, self.number_of = np.unique(self.phrases.own, return_index=True, return_inverse=True)
        pairs = np.lexsort((self.phrases.own, self.phrases.trigger))
        trigger, own = self.phrases.trigger[pairs], self.phrases.own[pairs]
        self.triggers, begin = np.unique(trigger, return_index=True)
        end = np.append(begin[1:], len(trigger)) - 1
        self.only = np.where(own[begin] == own[end], own[begin], 0) if len(begin) else own[begin]  # 0: several phrases

    def order_of(self, place: np.ndarray) -> np.ndarray:
        """order_id of the documents that hold these places."""
        return self.order[np.searchsorted(self.slab.bounds, place, "right") - 1]

    def mixed_phrases(self, earlier: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """First occurrences of phrases whose trigger has other phrases: the ones that are taken apart."""
        first_here = np.zeros(len(self.phrases.own), bool)
        first_here[self.first[~earlier]] = True
        return np.flatnonzero(first_here & mixed[np.searchsorted(self.triggers, self.phrases.trigger)])

    def strings(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of the strings of some phrases."""
        first, last = self.phrases.first[phrases], self.phrases.last[phrases]
        size = last - first + 1
        start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        hashes = np.empty(len(start), np.uint64)
        for at, part, sums in self.sums:
            own = slice(*np.searchsorted(start, [at, at + len(part.data)]))
            hashes[own] = span_hash(sums, start[own] - at, start[own] - at + LENGTH)
        return start, hashes


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed byte by byte: those of a chunk differ in few of them."""
    return pack(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T))


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def _question(chunk: int, first_bucket: int, buckets: int, keys: np.ndarray, extra: np.ndarray, plain: bool) -> pa.RecordBatch:
    order, cuts = deal(keys, buckets)
    own = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    parts = [order[cuts[k] : cuts[k + 1]] for k in own]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([first_bucket + k for k in own], pa.int32()),
            pa.array([chunk] * len(own), pa.int64()),
            pa.array([keys[p].tobytes() for p in parts], pa.binary()),
            pa.array([extra[p].tobytes() if plain else _planes(extra[p]) for p in parts], pa.binary()),
        ],
        ["bucket", "chunk", "keys", "extra"],
    )


def _parse_asker(buckets: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c = Chunk(batch, row)
                yield _question(c.number, 0, buckets, c.distinct, c.order_of(c.phrases.first[c.first]), plain=False)
                yield _question(c.number, buckets, buckets, c.triggers, c.only, plain=True)

    return asked


def _joined(questions: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys, row of each key, chunks."""
    parts = [np.frombuffer(b, np.uint64) for b in questions.column("keys").to_pylist()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), questions.column("chunk").to_pylist()


def _replies(bits: np.ndarray, row: np.ndarray, chunks: list[int], bucket: int) -> pa.Table:
    cuts = np.searchsorted(row, np.arange(len(chunks) + 1))
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "bucket": pa.array([bucket] * len(chunks), pa.int32()),
            "answer": pa.array([pack(bits[cuts[k] : cuts[k + 1]]) for k in range(len(chunks))], pa.binary()),
        }
    )


def _is_earlier(questions: pa.Table) -> pa.Table:
    """Of each key: whether another chunk has it in an earlier document; of equal order_id, in a chunk of smaller number."""
    keys, row, chunks = _joined(questions)
    order_id = np.concatenate([_from_planes(b) for b in questions.column("extra").to_pylist()])
    by_order = np.lexsort((np.array(chunks)[row], order_id))
    in_turn = by_order[np.argsort(keys[by_order], kind="stable")]
    earlier = np.zeros(len(keys), bool)
    earlier[in_turn[1:]] = keys[in_turn[1:]] == keys[in_turn[:-1]]
    return _replies(earlier, row, chunks, questions.column("bucket")[0].as_py())


def _answer(buckets: int):
    def answer(questions: pa.Table) -> pa.Table:
        bucket = questions.column("bucket")[0].as_py()
        if bucket < buckets:
            return _is_earlier(questions)
        keys, row, chunks = _joined(questions)
        only = np.concatenate([np.frombuffer(b, np.uint64) for b in questions.column("extra").to_pylist()])
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
        low, high = np.minimum.reduceat(only[order], begin), np.maximum.reduceat(only[order], begin)
        size = np.diff(np.append(begin, len(order)))
        mixed = np.empty(len(keys), bool)
        mixed[order] = np.repeat((low != high) | (low == 0), size)
        return _replies(mixed, row, chunks, bucket)

    return answer


def _in_text_order(bits: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    order, _ = deal(keys, buckets)
    found = np.empty(len(keys), bool)
    found[order] = bits
    return found


def _first_level(c: Chunk, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct phrases occur in earlier documents elsewhere; phrases that are taken apart."""
    bits = in_order(answers, bool)
    earlier = _in_text_order(bits[: len(c.distinct)], c.distinct, buckets)
    mixed = _in_text_order(bits[len(c.distinct) :], c.triggers, buckets)
    return earlier, c.mixed_phrases(earlier, mixed)


def _suffix_asker(buckets: int):
    def asked(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(chunk, 0)
        _, apart = _first_level(c, answers, buckets)
        start, hashes = c.strings(apart)
        distinct, first = np.unique(hashes, return_index=True)
        return pa.Table.from_batches([_question(c.number, 2 * buckets, buckets, distinct, c.order_of(start[first]), plain=False)])

    return asked


def _remover(buckets: int):
    def removed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(chunk, 0)
        level = answers.column("bucket").to_numpy() < 2 * buckets
        earlier, apart = _first_level(c, answers.filter(pa.array(level)), buckets)
        again = earlier[c.number_of]
        again |= c.first[c.number_of] != np.arange(len(again))
        start, hashes = c.strings(apart)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        before = _in_text_order(in_order(answers.filter(pa.array(~level)), bool), distinct, buckets)[number]
        before |= first[number] != np.arange(len(number))
        n = len(c.slab.data)
        gone = covered(
            np.concatenate([c.phrases.first[again], start[before]]),
            np.concatenate([c.phrases.last[again] + LENGTH, start[before] + LENGTH]),
            n,
        )
        runs, _, doc = c.slab.runs(gone)
        kept = []
        for a, b in zip(c.slab.bounds[:-1], c.slab.bounds[1:]):
            kept.append(hashlib.sha256(c.slab.data[a:b][~gone[a:b]].tobytes()).hexdigest())
        return pa.table(
            {
                "doc_id": chunk.column("doc_id").combine_chunks().flatten(),
                "n_bytes": np.diff(c.slab.bounds),
                "n_removed": c.slab.totals(gone),
                "n_spans": np.bincount(doc, minlength=c.slab.n),
                "kept_sha256": pa.array(kept, pa.string()),
                "spans": _spans(c.slab, gone),
            }
        )

    return removed


def _spans(slab: Slab, gone: np.ndarray) -> pa.Array:
    start, end, doc = slab.runs(gone)
    base = slab.bounds[doc]
    pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(slab.n + 1)), pa.int32()), pairs)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, byte behind the last) for every row.

    A byte of a text goes if it lies in a string of 100 bytes that also starts earlier, in a document of smaller doc_id
    or before in the same text; null ids come last. Rows of one doc_id follow each other within a chunk in the
    order of their texts and between chunks by place, so that of repeated rows one keeps its bytes. Texts are judged as they are
    given, in UTF-8; null texts are empty; texts under 100 bytes lose nothing. doc_id is an integer. Other columns are not
    looked at; an empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("order_id"), "text")
    with scope(docs.sparkSession):
        table = chunk_table(own, "repeat-chunks", sort_by=("order_id", "text"))
        buckets = bucket_count(table)
        asked = table.select("chunk", "order_id", "bounds", "data").mapInArrow(_parse_asker(buckets), QUESTION)
        reply = "chunk long, bucket int, answer binary"
        first = materialise(by_bucket(asked, _answer(buckets), reply), "repeat-phrases")
        suffixes = answered(table.drop("doc_id"), first, _suffix_asker(buckets), QUESTION)
        second = materialise(by_bucket(suffixes, _is_earlier, reply), "repeat-suffixes")
        schema = (
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
            "kept_sha256 string, spans array<struct<start:long,end:long>>"
        )
        return materialise(answered(table, first.unionAll(second), _remover(buckets), schema), "repeats", keep=True)
