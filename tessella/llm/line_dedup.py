"""Line dedup by winnowing over line hashes.

A text is its sequence of lines with a word. A window is a shortest run of lines that holds ``run_words`` words, seen
from its first line or from its last. Every window selects its smallest line hash as fingerprint, so any two equal runs
of that many words have a fingerprint in common. A text gives a row for each selected place only, whatever the number of
windows that selected it, with the lines they reach. Places are joined by fingerprint, and those whose fingerprint is
nowhere else are done. From the others the match is extended both ways, over the windows of the place: what they hold is
compared with the first place that has it too. Extensions of neighbouring places overlap and make up the longest repeated
runs. What starts later goes.

A place meets only the first one with the same window and not all of them, so a fingerprint of n places costs n rows; its
rows are dealt by what they extend to, and merged per task before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, scope
from .texts import NOT_BLANK, Slab, covered, mix, running, slabs, span_hash

RUN_WORDS = 25
WORD = r"[^\\x20\\x09-\\x0D]"
PLACE = "doc_id {id}, text_key long, fingerprint long, selected int, begin int, lines array<long>, words array<int>, numbers array<int>"
WINDOW = "doc_id {id}, text_key long, window long, first int, line_from int, line_to int"


def _trimmed(slab: Slab) -> tuple[np.ndarray, ...]:
    """Lines with a word: hash without blanks at the ends, words, document, number in the document's text."""
    words = slab.words(NOT_BLANK)
    start, end, doc = slab.lines()
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    from_word, to_word = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = to_word > from_word
    a, b = from_word[full], to_word[full]
    return span_hash(slab.sums, words.start[a], words.end[b - 1]), b - a, doc[full], number[full]


def _windows(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, docs: int, run_words: int) -> tuple[np.ndarray, ...]:
    """First, last and selected line of the windows of each document; ``doc`` is ascending."""
    n = len(hashes)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    upto = np.concatenate([[0], np.cumsum(words)])
    begin, end = np.searchsorted(doc, np.arange(docs)), np.searchsorted(doc, np.arange(docs), "right")
    line = np.arange(n)
    ahead = np.searchsorted(upto, upto[:-1] + run_words) - 1
    back = np.searchsorted(upto, upto[1:] - run_words, "right") - 1
    forward, backward = ahead < end[doc], back >= begin[doc]
    first = np.concatenate([line[forward], back[backward]])
    last = np.concatenate([ahead[forward], line[backward]])
    first, last = np.unique(np.stack([first, last]), axis=1)
    # the last of the smallest hashes, so that runs of equal lines agree on it
    low = np.uint64((1 << 24) - 1)
    key = (mix(hashes) & ~low) | ((low - line.astype(np.uint64)) & low)
    if not len(first):
        return first, last, first
    least = np.minimum.reduceat(np.append(key, ~np.uint64(0)), np.stack([first, last + 1], axis=1).reshape(-1))[::2]
    return first, last, last - ((last - (low - (least & low)).astype(np.int64)) & int(low))


def places(slab: Slab, run_words: int = RUN_WORDS) -> dict[str, np.ndarray]:
    """Selected places of each document: fingerprint, place, the first line its windows reach, and which lines they reach.

    Places count lines with a word; ``lines`` and the others are flat, ``bounds`` says where each place's begin.
    """
    hashes, words, doc, number = _trimmed(slab)
    first, last, selected = _windows(hashes, words, doc, slab.n, run_words)
    order = np.argsort(selected, kind="stable")
    place, at = np.unique(selected[order], return_index=True)
    if not len(place):
        return {c: place for c in ("fingerprint", "selected", "begin", "doc", "lines", "words", "numbers")} | {"bounds": np.zeros(1, np.int64)}
    low, high = np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at)
    bounds = np.concatenate([[0], np.cumsum(high - low + 1)])
    reached = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - low, high - low + 1)
    base = np.searchsorted(doc, doc[place])
    return {
        "fingerprint": hashes[place].view(np.int64), "selected": place - base, "begin": low - base, "doc": doc[place],
        "lines": hashes[reached].view(np.int64), "words": words[reached], "numbers": number[reached], "bounds": bounds,
    }


def _placed(run_words: int):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                p = places(slab, run_words)
                own = pa.array(p["doc"] + slab.first)
                columns = [batch.column(c).take(own) for c in ("doc_id", "text_key")]
                columns += [pa.array(p["fingerprint"], pa.int64()), pa.array(p["selected"], pa.int32()), pa.array(p["begin"], pa.int32())]
                bounds = pa.array(p["bounds"], pa.int32())
                for name, kind in (("lines", pa.int64()), ("words", pa.int32()), ("numbers", pa.int32())):
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(p[name], kind)))
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "text_key", "fingerprint", "selected", "begin", "lines", "words", "numbers"]
                )

    return placed


def _extended(run_words: int):
    """The windows that selected each place, from the lines they reach."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, numbers = (batch.column(c).flatten().to_numpy() for c in ("lines", "words", "numbers"))
            size = np.array(batch.column("lines").value_lengths())
            selected, begin = (batch.column(c).to_numpy().astype(np.int64) for c in ("selected", "begin"))
            row = np.repeat(np.arange(len(size)), size)
            base = np.cumsum(size) - size
            hashes = np.ascontiguousarray(lines).view(np.uint64)
            first, last, chosen = _windows(hashes, words, row, len(size), run_words)
            own = row[first] if len(first) else first
            kept = chosen - base[own] == (selected - begin)[own]
            first, last, own = first[kept], last[kept], own[kept]
            window = span_hash(running(mix(hashes)), first, last + 1)
            cells = [pa.array(window.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first - base[own] + begin[own], numbers[first], numbers[last]))]
            columns = [batch.column(c).take(pa.array(own)) for c in ("doc_id", "text_key")] + cells
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "window", "first", "line_from", "line_to"])

    return extended


def later_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text_key, runs: the later repeated windows of a text as (line_from, line_to), sorted.

    text_key is the hash of the text; ``docs`` has both besides text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scope(docs.sparkSession) as stored:
        found = stored(docs.select("doc_id", "text_key", "text").mapInArrow(_placed(run_words), PLACE.format(id=kind)), "line-places")
        # null ids come last, texts of one id in the order of their hashes, equal rows are one text
        own = (F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
        place = F.struct(*own, F.col("selected"))
        shared = found.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        shared = shared.where(~F.col("low").eqNullSafe(F.col("high"))).select("fingerprint")
        matches = found.join(shared, "fingerprint", "left_semi").drop("fingerprint")
        extended = stored(matches.mapInArrow(_extended(run_words), WINDOW.format(id=kind)), "line-windows")
        start = F.struct(*own, F.col("first"))
        origin = extended.groupBy("window").agg(F.min(start).alias("origin"), F.max(start).alias("farthest"))
        origin = origin.where(~F.col("origin").eqNullSafe(F.col("farthest")))
        matched = extended.join(origin.select("window", "origin"), "window").where(~start.eqNullSafe(F.col("origin")))
        runs = F.array_sort(F.collect_set(F.struct("line_from", "line_to"))).alias("runs")
        return materialise(matched.groupBy("doc_id", "text_key").agg(runs), "line-runs", keep=True)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
            lines = (text.as_py() or "").split("\n")
            gone = np.zeros(len(lines), bool)
            if runs:
                gone = covered(np.array([r["line_from"] for r in runs]), np.array([r["line_to"] + 1 for r in runs]), len(lines))
            counts.append((len(lines), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())))
            texts.append("\n".join(s for s, g in zip(lines, gone) if not g) if gone.any() else text.as_py())
        found = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), pa.array(texts, pa.string()), *found], ["rest", "text", "n_lines", "n_removed", "n_runs"]
        )


def _deduped(docs: DataFrame, run_words: int) -> DataFrame:
    """rest (a struct of the columns but text), text, n_lines, n_removed, n_runs."""
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("rest"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("text_key", F.xxhash64("text"))
    runs = later_runs(keyed.select("rest.doc_id", "text_key", "text"), run_words)
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("text_key").alias("run_key"), "runs")
    same = F.col("rest.doc_id").eqNullSafe(F.col("run_id")) & (F.col("text_key") == F.col("run_key"))
    # the same plan at every size: texts are dealt by their key, but not sorted
    joined = keyed.join(runs.hint("shuffle_hash"), same, "left").select("rest", "text", "runs")
    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(_cleaned, f"rest {kind}, text string, n_lines long, n_removed long, n_runs long")


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text without later repeated runs, n_lines, n_removed (lines), n_runs for every row of ``docs``.

    A run is a number of lines in a row, blank ones not counted, with at least ``run_words`` words together; two runs are
    equal if their lines are, but for blanks at the ends. A line goes if it lies in a run that also starts earlier: in a
    text of smaller doc_id, or before in the same text; blank lines between removed ones go as well. Null ids come last,
    texts of one id in the order of their hashes; repeated rows are one text and get the same result. Null texts stay
    null and have one empty line. Other columns are not looked at; an empty table gives no rows.
    """
    return _deduped(docs.select("doc_id", "text"), run_words).select("rest.doc_id", "text", "n_lines", "n_removed", "n_runs")


def without_repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the texts of ``dedup_lines``. Texts that lose their last word go; the other columns stay."""
    found = _deduped(docs, run_words).where(f"n_removed = 0 or text rlike '{WORD}'")
    return found.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
