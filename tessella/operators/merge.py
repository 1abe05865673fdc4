"""Merging tables along column links.

The links form a graph over the tables. It is folded on the driver, where only names and types are
looked at, into one lazy chain of inner equi-joins: Spark sees all joins at once and picks strategies,
splits skewed join partitions and prunes columns itself. Nothing is counted on the way.

Rules
- All links between the two parts being joined make one composite key, whatever their direction.
- A linked pair becomes one column named ``left_right``, or just ``left`` if the names agree.
- A column that takes part in several links is found again by (table, column).
- Columns that would share a name get the table's name as suffix.
- The row-id column ``id`` is dropped, unless it is itself linked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DisconnectedTables, KeyTypeMismatch, NoRows, UnsupportedColumn
from ..functions.cells import column
from ..functions.kinds import NUMERIC, TEMPORAL, TEXT, is_floating, kind
from ..functions.names import key_name, require_unique

ROW_ID = "id"
# Tasks for each core that the largest table is dealt to.
SPREAD = 4


@dataclass(frozen=True)
class Link:
    """Two tables and the column pairs that must be equal."""

    left: str
    right: str
    pairs: tuple[tuple[str, str], ...]

    @staticmethod
    def of(left: str, right: str, *pairs: tuple[str, str]) -> Link:
        return Link(left, right, tuple((a, b) for a, b in pairs))

    def record(self) -> dict:
        """Plain form, to be stored with a model and replayed on other tables."""
        return {"from": self.left, "to": self.right, "connections": [list(p) for p in self.pairs]}

    @staticmethod
    def from_record(record: Mapping) -> Link:
        def table(end):
            return str(end["id"] if isinstance(end, Mapping) else end)

        return Link.of(table(record["from"]), table(record["to"]), *[tuple(p) for p in record["connections"]])

    def __str__(self) -> str:
        return " and ".join(f"{self.left}.{a}={self.right}.{b}" for a, b in self.pairs)


def _common_type(left: T.DataType, right: T.DataType, what: str) -> T.DataType | None:
    """Type both keys are compared in; None if they have one already."""
    if left == right:
        return None
    a, b = kind(left), kind(right)
    if a == b == NUMERIC:
        if isinstance(left, T.IntegralType) != isinstance(right, T.IntegralType) and (is_floating(left) or is_floating(right)):
            return T.LongType()
        if is_floating(left) or is_floating(right):
            return T.DoubleType()
        if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
            return T.DecimalType(38, max(getattr(t, "scale", 0) for t in (left, right)))
        return T.LongType()
    if a == b == TEXT:
        return T.StringType()
    if a == b == TEMPORAL:
        return T.TimestampType()
    raise KeyTypeMismatch(f"{what}: {left.simpleString()} and {right.simpleString()}; pass text_keys=True to compare as text")


def _as_key(name: str, own: T.DataType, common: T.DataType | None) -> Column:
    """The key in the common type, null where it has no such value. A float equals a whole number only if it is that number."""
    key = F.col(name)
    if common is None:
        return key
    if is_floating(own) and isinstance(common, T.LongType):
        value = key.cast("double")
        return F.when((value >= -(2.0**63)) & (value < 2.0**63) & (value == F.rint(value)), key.try_cast(common))
    return key.try_cast(common)


class _Part:
    """Tables joined so far: a frame with internal column names, and what they are called."""

    def __init__(self, df: DataFrame, tables: set[str], cells: dict[tuple[str, str], str], labels: dict[str, str]):
        self.df, self.tables, self.cells, self.labels = df, tables, cells, labels


def _start(position: int, table: str, df: DataFrame, linked: set[tuple[str, str]]) -> _Part:
    missing = sorted(c for t, c in linked if t == table and c not in df.columns)
    if missing:
        raise UnsupportedColumn(f"links name unknown columns of {table}: {missing}")
    if ROW_ID in df.columns and (table, ROW_ID) not in linked:
        df = df.drop(ROW_ID)
    inner = [f"t{position}_{i}" for i in range(len(df.columns))]
    return _Part(
        df.toDF(*inner),
        {table},
        {(table, c): n for c, n in zip(df.columns, inner)},
        dict(zip(inner, df.columns)),
    )


def _classes(pairs: Iterable[tuple[str, str]]) -> list[tuple[list[str], list[str], list[tuple[str, str]]]]:
    """Group column pairs that share a column: each group becomes one key."""
    groups: list[tuple[list[str], list[str], list[tuple[str, str]]]] = []
    for a, b in pairs:
        touching = [g for g in groups if a in g[0] or b in g[1]]
        lefts = list(dict.fromkeys([c for g in touching for c in g[0]] + [a]))
        rights = list(dict.fromkeys([c for g in touching for c in g[1]] + [b]))
        joined = (lefts, rights, [p for g in touching for p in g[2]] + [(a, b)])
        groups = [g for g in groups if g not in touching] + [joined]
    return groups


def _equal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for other in names[1:]:
        df = df.where(F.col(names[0]) == F.col(other))
    return df


def _join(left: _Part, right: _Part, links: Sequence[tuple[tuple[str, str], tuple[str, str]]], key_start: int, text_keys: bool) -> _Part:
    pairs = list(dict.fromkeys((left.cells[a], right.cells[b]) for a, b in links))
    left_keys: dict[str, Column] = {}
    right_keys: dict[str, Column] = {}
    labels: dict[str, str] = {}
    renamed: dict[str, str] = {}
    left_df, right_df = left.df, right.df
    for i, (lefts, rights, group) in enumerate(_classes(pairs)):
        key = f"k{key_start + i}"
        left_df, right_df = _equal(left_df, lefts), _equal(right_df, rights)
        a, b = left_df.schema[lefts[0]].dataType, right_df.schema[rights[0]].dataType
        what = f"{left.labels[lefts[0]]} = {right.labels[rights[0]]}"
        try:
            common = _common_type(a, b, what)
        except KeyTypeMismatch:
            if not text_keys:
                raise
            common = T.StringType()
        left_keys[key], right_keys[key] = _as_key(lefts[0], a, common), _as_key(rights[0], b, common)
        name = key_name(left.labels[group[0][0]], right.labels[group[0][1]])
        seen = set(group[0])
        for x, y in group[1:]:
            for inner, label in ((x, left.labels), (y, right.labels)):
                if inner not in seen:
                    name = key_name(name, label[inner])
                    seen.add(inner)
        labels[key] = name
        renamed.update({c: key for c in (*lefts, *rights)})

    def with_keys(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
        return df.select(*[v.alias(k) for k, v in keys.items()], *[c for c in df.columns if c not in renamed])

    joined = with_keys(left_df, left_keys).join(with_keys(right_df, right_keys), list(labels), "inner")
    cells = {cell: renamed.get(n, n) for cell, n in {**left.cells, **right.cells}.items()}
    labels.update({n: s for n, s in {**left.labels, **right.labels}.items() if n not in renamed})
    return _Part(joined, left.tables | right.tables, cells, labels)


def _source_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _spread(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, the largest one dealt to all tasks if one split holds it: a join makes many rows of each where values
    repeat on both sides, and the task that reads a row of the larger table makes them."""
    sizes = {name: _source_bytes(df) for name, df in tables.items()}
    largest = max(sizes, key=sizes.get, default=None)
    if len(tables) < 2 or sizes[largest] == 0:
        return dict(tables)
    spark = tables[largest].sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if sizes[largest] > split:
        return dict(tables)
    tasks = SPREAD * spark.sparkContext.defaultParallelism
    return {name: df.repartition(tasks) if name == largest else df for name, df in tables.items()}


def _fold(tables: Mapping[str, DataFrame], links: Sequence[Link], text_keys: bool) -> _Part:
    ends = [((link.left, a), (link.right, b)) for link in links for a, b in link.pairs]
    unknown = sorted({t for pair in ends for t, _ in pair} - set(tables))
    if unknown:
        raise DisconnectedTables(f"links name unknown tables: {unknown}")
    linked = {end for pair in ends for end in pair}
    parts = [_start(i, t, df, linked) for i, (t, df) in enumerate(tables.items())]

    def part_of(table: str) -> _Part:
        return next(p for p in parts if table in p.tables)

    keys = 0
    for (left_table, left_column), (right_table, right_column) in ends:
        left, right = part_of(left_table), part_of(right_table)
        if left is right:
            a, b = left.cells[left_table, left_column], left.cells[right_table, right_column]
            if left_table == right_table and a != b:  # a link within one table is a filter
                left.df = _equal(left.df, [a, b])
            continue
        between = []
        for a, b in ends:
            if a[0] in left.tables and b[0] in right.tables:
                between.append((a, b))
            elif b[0] in left.tables and a[0] in right.tables:
                between.append((b, a))
        joined = _join(left, right, between, keys, text_keys)
        keys += len(between)
        parts = [p for p in parts if p is not left and p is not right] + [joined]
    if len(parts) > 1:
        raise DisconnectedTables(f"links leave separate groups: {[sorted(p.tables) for p in parts]}")
    return parts[0]


def _final_names(part: _Part) -> dict[str, str]:
    """Internal to shown names; equal names of non-key columns get the table as suffix."""
    shown = Counter(label.lower() for label in part.labels.values())
    table_of = {inner: table for (table, _), inner in part.cells.items()}
    names = {}
    for inner in part.df.columns:
        label = part.labels[inner]
        is_key = inner.startswith("k")
        names[inner] = label if is_key or shown[label.lower()] == 1 else f"{label}_{table_of[inner]}"
    require_unique(list(names.values()))
    return names


def merge_graph(
    tables: Mapping[str, DataFrame], links: Sequence[Link], text_keys: bool = False, require_rows: bool = False
) -> DataFrame:
    part = _fold(_spread(tables), links, text_keys)
    names = _final_names(part)
    merged = part.df.select(*[F.col(inner).alias(name) for inner, name in names.items()])
    if require_rows and merged.isEmpty():
        raise NoRows(f"no row satisfies {', '.join(map(str, links))}")
    return merged


def merged_names(tables: Mapping[str, DataFrame], links: Sequence[Link], text_keys: bool = False) -> dict[tuple[str, str], str]:
    """(table, column) to the name it has in the merged frame."""
    part = _fold(tables, links, text_keys)
    names = _final_names(part)
    return {cell: names[inner] for cell, inner in part.cells.items() if inner in names}


def merge_two(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], names: tuple[str, str] = ("left", "right"), **options
) -> DataFrame:
    return merge_graph({names[0]: left, names[1]: right}, [Link.of(*names, *pairs)], **options)


def replay(records: Sequence[Mapping], tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """Merge other tables along stored links."""
    return merge_graph(tables, [Link.from_record(r) for r in records], **options)


__all__ = ["Link", "merge_graph", "merge_two", "merged_names", "replay"]
