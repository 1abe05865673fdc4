"""Records of large text files, read split by split, where only the text before a place tells whether a record ends there.

A line break in a CSV file ends a record unless it is quoted; a closing brace in a JSON document ends an element of its
array unless it is in a text or deeper down. Spark's text source cuts files at every separator, in any split. What a line
does is a function of the state it begins in: within quotes or not, and how many braces are open. Such functions compose,
so each split is first reduced to one of them, on the executors and without knowing where it begins; running
compositions over the splits of a file, a row for each, then give the state every split begins in; and a second scan puts
the lines of a split together to records. What a record has in several splits is joined by a shuffle of these parts
alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import TessellaError
from ..executors import ship_package
from ..scratch import materialise, scope

#: Files larger than this are read by more than one task.
SPLIT_BYTES = 8 << 20


@dataclass
class Effects:
    """Of each line: the quoting it leaves (1: within quotes) and the braces it opens, if it begins without and within."""

    quoting: tuple[np.ndarray, np.ndarray]
    opened: tuple[np.ndarray, np.ndarray]

    def before(self, quoting: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Quoting and depth in front of each line, and behind the last."""
        n = len(self.quoting[0])
        after = [q.tolist() for q in self.quoting]
        changing = np.flatnonzero((self.quoting[0] != 0) | (self.quoting[1] != 1))
        states = [quoting]
        for line in changing.tolist():
            states.append(after[states[-1]][line])
        quotings = np.repeat(np.array(states, np.int8), np.diff(np.concatenate([[-1], changing, [n - 1]])))
        depths = depth + np.cumsum(np.where(quotings == 0, *self.opened))
        return quotings, np.concatenate([[depth], depths[:-1]])[:n], states[-1], int(depths[-1]) if n else depth


@dataclass(frozen=True)
class Grammar:
    """``effects`` of lines that end with ``separator``; ``opening``: what the first line of a file may begin with, left out."""

    separator: str
    effects: Callable[[pa.Array], Effects]
    opening: str = r"(?!)"


# A value is quoted if a quote begins it; quotes in it are doubled; anything else up to the next comma belongs to it.
_TO_QUOTE = re.compile(r'(?:"(?:[^"]|"")*+"[^,]*+,|[^",][^,]*+,|,)*+"(?:[^"]|"")*+\Z')
_FROM_QUOTE = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:,(.*))?\Z', re.DOTALL)


def csv_effect(line: str) -> tuple[int, int]:
    """The quoting a line leaves if it begins without quotes, and within."""
    plain = 1 if _TO_QUOTE.match(line) else 0
    closed = _FROM_QUOTE.match(line)
    if not closed:
        return plain, 1
    return plain, 1 if closed[1] is not None and _TO_QUOTE.match(closed[1]) else 0


def csv_effects(lines: pa.Array) -> Effects:
    outside, inside = np.zeros(len(lines), np.int8), np.ones(len(lines), np.int8)
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        outside[k], inside[k] = csv_effect(lines[k].as_py())
    none = np.zeros(len(lines), np.int64)
    return Effects((outside, inside), (none, none))


_ESCAPE = re.compile(r"\\.", re.DOTALL)


def json_effect(line: str) -> tuple[bool, int, int]:
    """Whether a piece in front of a closing brace changes the quoting, and what it opens from without and from within."""
    if "\\" in line:
        line = _ESCAPE.sub("", line)
    parts = line.split('"')
    opened = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    opened[(len(parts) - 1) % 2] -= 1  # the brace behind it
    return len(parts) % 2 == 0, *opened


def json_effects(lines: pa.Array) -> Effects:
    found = [json_effect(line) for line in lines.to_pylist()]
    changes, outside, inside = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
    return Effects((changes.astype(np.int8), 1 - changes.astype(np.int8)), (outside, inside))


CSV = Grammar("\n", csv_effects)
JSON = Grammar("}", json_effects, r"\s*\[")


def _lines(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """Lines in the order of their split: value, file, block (where the split begins)."""
    read = spark.read.option("lineSep", grammar.separator).text(path)
    return read.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[tuple[int, int, bool, int, pa.Array]]:
    """file, block, whether a new split begins, bytes left out at the beginning of the file, lines."""
    known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column("value")
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
            split, lines = (int(file[a]), int(block[a])), value.slice(a, b - a)
            opening = 0
            if split != known and split[1] == 0:
                first = lines[0].as_py()
                rest = re.sub(r"\A" + grammar.opening, "", first)
                opening = len(first.encode()) - len(rest.encode())
                lines = pa.concat_arrays([pa.array([rest], lines.type), lines.slice(1)])
            yield *split, split != known, opening, lines
            known = split


MEASURED = "file long, block long, quoting_0 int, quoting_1 int, opened_0 long, opened_1 long, bytes long, blank_end boolean, array boolean"


def _measurer(grammar: Grammar):
    """What each split does, from either quoting."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for file, block, fresh, opening, lines in _by_split(batches, grammar):
            if fresh:
                found.append([file, block, 0, 1, 0, 0, opening, True, opening > 0])
            own = found[-1]
            effects = grammar.effects(lines)
            for k in (0, 1):
                _, _, own[2 + k], own[4 + k] = effects.before(own[2 + k], own[4 + k])
            own[6] += pc.sum(pc.binary_length(lines)).as_py() + len(lines) * len(grammar.separator)
            own[7] = not lines[-1].as_py().strip(" \t\r\n]")
        names = [f.split()[0] for f in MEASURED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = list(zip(*found)) if found else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return measured


def _states(measured: DataFrame) -> DataFrame:
    """``measured`` with the quoting and depth each split begins in."""
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("quoting_0") == F.col("quoting_1"), F.col("quoting_0"))
    known = measured.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(before), "since": F.count(fixed).over(before)})
    # behind the last split that leaves the same whatever it begins in, the others keep the quoting or change it
    turns = F.when(fixed.isNull() & (F.col("quoting_0") == 1), 1).otherwise(0)
    same = Window.partitionBy("file", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoting = (F.coalesce("fixed", F.lit(0)) + F.coalesce(F.sum("turn").over(same), F.lit(0))) % 2
    known = known.withColumn("turn", turns).withColumn("quoting", quoting.cast("int"))
    opened = F.when(F.col("quoting") == 0, F.col("opened_0")).otherwise(F.col("opened_1"))
    return known.withColumn("depth", F.coalesce(F.sum(opened).over(before), F.lit(0)))


RECORD = "record string, file long, block long, whole boolean, starts boolean, first boolean"


def _assembler(grammar: Grammar, begun):
    """Records of each split; the parts of those that other splits share are not whole."""

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, blocks, quotings, depths = begun.value
        quoting = depth = 0
        open_lines: list[str] = []
        split, starts, first, seen = (0, 0), True, False, False
        rows: list[tuple] = []

        def part(whole: bool) -> None:
            rows.append((grammar.separator.join(open_lines), *split, whole and starts, starts, first))
            open_lines.clear()

        def batch() -> pa.RecordBatch:
            names = [f.split()[0] for f in RECORD.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            rows.clear()
            return made

        for file, block, fresh, _, lines in _by_split(batches, grammar):
            if fresh:
                if open_lines:
                    part(quoting == 0 and depth == 0)
                split, starts, first = (file, block), False, False
                low = np.searchsorted(files, file)
                at = low + np.searchsorted(blocks[low : np.searchsorted(files, file, "right")], block)
                here = at < len(files) and files[at] == file and blocks[at] == block
                quoting, depth = (int(quotings[at]), int(depths[at])) if here else (0, 0)
                seen = block != 0
            own = lines.to_pylist()
            quotings_before, depths_before, quoting, depth = grammar.effects(lines).before(quoting, depth)
            begins = np.flatnonzero((quotings_before == 0) & (depths_before == 0)).tolist()
            open_lines += own[: begins[0]] if begins else own
            for a, b in zip(begins, [*begins[1:], len(own)]):
                if open_lines:
                    part(True)
                open_lines += own[a:b]
                starts, first, seen = True, not seen, True
            yield batch()
        if open_lines:
            part(quoting == 0 and depth == 0)
        yield batch()

    return assembled


def _joined_parts(parts: DataFrame, separator: str) -> DataFrame:
    """Records from their parts: one that starts a record, and those in the splits behind it. ``parts`` is stored."""
    places = Window.partitionBy("file").orderBy("block", "starts")
    lean = parts.select("file", "block", "starts").withColumn("begin", F.last(F.when(F.col("starts"), F.col("block")), ignorenulls=True).over(places))
    known = parts.join(lean, ["file", "block", "starts"])
    own = F.sort_array(F.collect_list(F.struct("block", "starts", "record")))
    whole = known.groupBy("file", "begin").agg(own.alias("own"), F.max("first").alias("first"))
    return whole.select(F.array_join(F.col("own.record"), separator).alias("record"), "first")


def _records(spark: SparkSession, path: str, grammar: Grammar, checked: bool) -> DataFrame:
    """record, first (of its file). ``checked``: every file must close what it opens."""
    ship_package(spark)
    lines = _lines(spark, path, grammar)
    with scope(spark) as stored:
        states = stored(_states(lines.mapInArrow(_measurer(grammar), MEASURED)), "splits")
        if checked:
            last = F.max_by(F.struct("*"), "block").alias("last")
            files = states.groupBy("file").agg(last, F.sum("bytes").alias("bytes"), F.max("array").alias("array"))
            sizes = spark.read.format("binaryFile").load(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), "length", "path")
            plain = F.col("last.quoting") == 0
            closed = F.when(plain, F.col("last.opened_0")).otherwise(F.col("last.opened_1")) + F.col("last.depth")
            quoted = F.when(plain, F.col("last.quoting_0")).otherwise(F.col("last.quoting_1")) == 1
            # behind the last brace of a file comes nothing but its end; that end counts as one more brace
            ends = F.when(F.col("bytes") > F.col("length"), -1).otherwise(0) - F.col("array").cast("int")
            broken = files.join(sizes, "file").where(quoted | (closed != ends) | ((F.col("bytes") > F.col("length")) & ~F.col("last.blank_end")))
            if found := broken.select("path").first():
                raise TessellaError(f"{found['path']} does not hold one JSON document")
        # a row for each split that begins within a record
        begun = states.where("quoting <> 0 or depth <> 0").select("file", "block", "quoting", "depth").orderBy("file", "block").toArrow()
    inside = spark.sparkContext.broadcast(tuple(begun.column(c).to_numpy() for c in ("file", "block", "quoting", "depth")))
    assembled = lines.mapInArrow(_assembler(grammar, inside), RECORD)
    if not begun.num_rows:
        return assembled.select("record", "first")
    whole = assembled.where("whole").select("record", "first")
    parts = materialise(assembled.where("not whole").drop("whole"), "record-parts")
    return whole.unionAll(_joined_parts(parts, grammar.separator))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record, first (whether it is the first one of its file) of CSV files; without empty lines.

    A line break is \\n or \\r\\n. A quoted value that a file does not close reaches to its end.
    """
    found = _records(spark, path, CSV, checked=False)
    cut = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return found.select(cut.alias("record"), "first").where("record <> ''")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """record: the objects of JSON files that hold one array of objects, or objects one after the other."""
    found = _records(spark, path, JSON, checked=True)
    cut = F.regexp_replace("record", r"^[\s,]+", "")
    found = found.select(cut.alias("record")).where(r"record rlike '[^\\s\\]]'")
    return found.select(F.concat("record", F.lit(JSON.separator)).alias("record"))
