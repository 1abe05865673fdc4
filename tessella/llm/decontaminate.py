"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of consecutive words, a shingle is a word. The shingles of a window are ordered by
their number of occurrences in the documents. A document contains the window only if it has all of its shingles, so the
rarest one is the necessary prefix: it alone is looked up in the documents. A match gives the one place where the window
could be; it is dropped if the window would begin before or end after the text (positional and length bound), and else
compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .texts import LETTER_OR_DIGIT, covered, slabs

WINDOW = 13
#: Bytes of benchmark text, and windows of it, that are sent to the executors at once. A larger benchmark is taken in
#: several blocks, one after the other. A window takes about 140 bytes.
BLOCK_BYTES = 16 << 20
BLOCK_WINDOWS = 1 << 19
#: Windows of an item that stay together.
PIECE = 1 << 12
#: Bits of the table that tells most words from prefixes.
SIEVE = 20


@dataclass
class Windows:
    """Distinct windows: words (n, WINDOW) padded with 0, and sizes (n).

    Window k occurs in the items with ids[i] for i in items[first[k]:first[k + 1]]; ids are sorted.
    """

    words: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    ids: list[str]

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.words[np.arange(self.words.shape[1]) < self.sizes[:, None]])


@dataclass
class Prefixes:
    """Sorted prefix words; those of word k are entries[first[k]:first[k + 1]], a window and the word's place in it."""

    words: np.ndarray
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray


class Lookup:
    """Finds members of a sorted array among many words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[words >> np.uint64(64 - SIEVE)] = True

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the members in ``asked``, and their numbers."""
        place = np.flatnonzero(self.sieve[asked >> np.uint64(64 - SIEVE)])
        number = np.searchsorted(self.words, asked[place])
        number[number == len(self.words)] = 0
        right = self.words[number] == asked[place] if len(self.words) else np.zeros(0, bool)
        return place[right], number[right]


def item_windows(items: list[tuple[str, str]], size: int = WINDOW) -> Windows:
    """Windows of (id, text) pairs; an item of fewer words, but not none, is one window."""
    ids = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(ids)}
    rows, owners = [np.zeros((0, size + 1), np.uint64)], [np.zeros(0, np.int64)]
    for slab in slabs(pa.array([t for _, t in items], pa.string()), lower_case=True):
        words = slab.words(LETTER_OR_DIGIT)
        for k in np.flatnonzero(words.counts):
            own = words.hash[words.first[k] : words.first[k + 1]]
            width = min(size, len(own))
            row = np.zeros((len(own) - width + 1, size + 1), np.uint64)
            row[:, :width] = np.lib.stride_tricks.sliding_window_view(own, width)
            row[:, size] = width
            rows.append(row)
            owners.append(np.full(len(row), number[items[slab.first + k][0]]))
    whole = np.concatenate(rows)
    _, place, window = np.unique(whole.view(f"V{8 * (size + 1)}").reshape(-1), return_index=True, return_inverse=True)
    pairs = np.unique(window.reshape(-1) * max(len(ids), 1) + np.concatenate(owners))
    of, item = np.divmod(pairs, max(len(ids), 1))
    distinct = whole[place]
    first = np.searchsorted(of, np.arange(len(place) + 1))
    return Windows(np.ascontiguousarray(distinct[:, :size]), distinct[:, size].astype(np.int64), first, item, ids)


def prefixes(windows: Windows, vocabulary: np.ndarray, counts: np.ndarray) -> Prefixes:
    """The rarest word of each window; among equally rare ones the one with the smaller hash."""
    known = np.arange(windows.words.shape[1]) < windows.sizes[:, None]
    place_of = np.searchsorted(vocabulary, windows.words).clip(0, max(len(vocabulary) - 1, 0))
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
    place = np.where(known, rank[place_of], len(vocabulary)).argmin(axis=1)
    word = windows.words[np.arange(len(place)), place]
    order = np.argsort(word, kind="stable")
    distinct, first = np.unique(word[order], return_index=True)
    return Prefixes(distinct, np.append(first, len(order)), order, place[order])


def _counter(vocabulary):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(vocabulary.value)
        total = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for slab in slabs(batch.column("text"), lower_case=True):
                total += np.bincount(known(slab.words(LETTER_OR_DIGIT).hash)[1], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["number", "n"])

    return counted


def _entries(first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked k the number of entries first[k]:first[k + 1], and all of these in a row."""
    times = np.diff(first)[asked]
    return times, np.repeat(first[asked] - (np.cumsum(times) - times), times) + np.arange(times.sum())


def _matcher(shared):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, index = shared.value
        known = Lookup(index.words)
        ids, n_ids, n_windows = pa.array(windows.ids, pa.string()), max(len(windows.ids), 1), max(len(windows.sizes), 1)
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for slab in slabs(batch.column("text"), lower_case=True):
                words = slab.words(LETTER_OR_DIGIT)
                place, number = known(words.hash)
                times, entry = _entries(index.first, number)
                window, start = index.window[entry], np.repeat(place, times) - index.place[entry]
                doc, size = np.repeat(words.doc[place], times), windows.sizes[window]
                inside = (start >= words.first[doc]) & (start + size <= words.first[doc + 1])
                window, start, doc, size = window[inside], start[inside], doc[inside], size[inside]
                for k in range(windows.words.shape[1]):
                    at = np.minimum(start + k, max(len(words) - 1, 0))
                    same = (size <= k) | (words.hash[at] == windows.words[window, k])
                    window, start, doc, size = window[same], start[same], doc[same], size[same]
                hit = np.flatnonzero(covered(start, start + size, len(words)))
                hit_doc = words.doc[hit]
                hits = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(hit_doc, np.arange(slab.n + 1)), pa.int32()), pa.array(hit - words.first[hit_doc])
                )
                doc, window = np.divmod(np.unique(doc * n_windows + window), n_windows)
                times, entry = _entries(windows.first, window)
                doc, item = np.divmod(np.unique(np.repeat(doc, times) * n_ids + windows.items[entry]), n_ids)
                items = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(slab.n + 1)), pa.int32()), ids.take(pa.array(item))
                )
                own = rest.slice(slab.first, slab.n)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(words.counts.astype(np.int64)), hits, items],
                    [*own.schema.names, "n_words", "hits", "items"],
                )

    return matched


def find_windows(docs: DataFrame, items: list[tuple[str, str]], size: int = WINDOW) -> tuple[DataFrame, list[Broadcast]]:
    """Adds n_words, hits (places of words in an occurrence of a window) and items (ids, sorted) instead of text.

    The broadcasts are needed until the rows are read.
    """
    context = docs.sparkSession.sparkContext
    windows = item_windows(items, size)
    vocabulary = windows.vocabulary()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    asked = context.broadcast(vocabulary)
    rarity = texts.mapInArrow(_counter(asked), "number long, n long")
    counts = np.zeros(len(vocabulary), np.int64)
    for row in rarity.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row for a word of the block at most
        counts[row["number"]] = row["n"]
    shared = context.broadcast((windows, prefixes(windows, vocabulary, counts)))
    names = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    found = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(
        _matcher(shared), ", ".join([*fields, "n_words long, hits array<long>, items array<string>"])
    )
    return found, [asked, shared]


def _splitter(size: int, most: int):
    """Pieces of items with at most so many windows each; lower-cased, from the first word to the last."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text"), lower_case=True):
                words = slab.words(LETTER_OR_DIGIT)
                owner, texts, windows = [], [], []
                for k in np.flatnonzero(words.counts):
                    a, b = words.first[k], words.first[k + 1]
                    for at in range(a, max(b - size, a) + 1, most):
                        end = min(at + most + size - 1, b)
                        owner.append(slab.first + k)
                        texts.append(slab.data[words.start[at] : words.end[end - 1]].tobytes())
                        windows.append(max(end - at - size + 1, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(owner, pa.int64())),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(windows, pa.int64()),
                    ],
                    ["item_id", "text", "windows"],
                )

    return split


def item_blocks(pieces: DataFrame, block_bytes: int, block_windows: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct stored ``pieces`` in blocks of at most so many bytes and windows; a larger piece is a block of its own.

    One block if all are within the bounds. Pieces are small and none comes twice, so hashes deal them evenly.
    """
    sizes = pieces.agg(F.sum(F.octet_length("text") + 32), F.sum("windows")).first()
    parts = max(1, *(-(-int(n or 0) // most) for n, most in zip(sizes, (block_bytes, block_windows))))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    block: list[tuple[str, str]] = []
    n_bytes = n_windows = 0
    for k in range(parts):
        for item_id, text, windows in pieces.where(part == k).collect():
            own = len(text.encode()) + 32
            if block and (n_bytes + own > block_bytes or n_windows + windows > block_windows):
                yield block
                block, n_bytes, n_windows = [], 0, 0
            block.append((item_id, text))
            n_bytes, n_windows = n_bytes + own, n_windows + windows
    yield block


def _store(parts: list[DataFrame], used: list[Broadcast]) -> None:
    """Writes the last part, which frees what it was found with."""
    parts[-1] = materialise(parts[-1], "benchmark-block")
    for shared in used:
        shared.destroy()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    share: int = 20,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """doc_id, text_key (hash of the text), n_words, n_hit, n_items, items, contaminated for every row of ``docs``.

    A word of a document is hit if it lies in an occurrence of a window of ``size`` words of an item; an item of fewer
    words, but not none, is one window. items: ids, as text and sorted, of items with occurring windows; rows of one id
    are one item, and a null id is the text ``null``. contaminated: a hit, and ``share`` times the hits are at least the
    words. Null and empty texts have no words. Repeated rows are judged each; other columns are not looked at; without
    items nothing is hit, and an empty table gives no rows.
    """
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    items = benchmark.select(item_id.alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = items.mapInArrow(_splitter(size, min(PIECE, block_windows)), "item_id string, text string, windows long")
    pieces = materialise(pieces.distinct(), "benchmark-pieces")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    parts, used = [], []
    for block in item_blocks(pieces, block_bytes, block_windows):
        if used:  # several blocks: the driver and the workers hold one at a time
            _store(parts, used)
        part, used = find_windows(own, block, size)
        parts.append(part)
    found = parts[0]
    if len(parts) > 1:
        _store(parts, used)
        found = parts[0]
        for part in parts[1:]:
            found = found.unionAll(part)
        same = found.groupBy("doc_id", "text_key", "n_words").agg(
            F.flatten(F.collect_set("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
        )
        found = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        found = found.withColumn("hits", F.array_distinct("hits"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; all columns as they are."""
    bad = contamination(docs, benchmark, **settings).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("bad_key"))
    return whole.join(bad, same, "left_anti").select("row.*")
