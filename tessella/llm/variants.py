"""Grouping of spelling variants by k-d trees over letter counts.

A word is a point: how often each letter occurs in it, other letters than a to z folded into a few dimensions. One
inserted or deleted letter moves it by one, one replaced letter by two at most (sum of the differences). So the words one
edit away from a word are among the points near it, in the trees of its own length (two at most) and of the lengths next
to it (one). Each length has a tree. Its upper levels are split planes from a bounded sample and divide the points into
cells; a word is sent to all cells that the planes leave within its reach. A cell's points make a tree with exact boxes,
searched by all words sent there at once; points in reach are compared letter by letter.

A cell holds a bounded number of letters, whatever the sample says: cells with more are cut into slices of points and
slices of searching words, and each slice of the one meets each of the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, scope

#: Dimensions of a to z and of all other letters.
LETTERS, OTHERS = 26, 6
MIN_LETTERS, MIN_COUNT = 5, 3
#: Words the planes are learned from at most, and how many of them make a cell at least.
SAMPLE, PER_CELL = 200_000, 16
#: Letters of a cell's points at most, and as a multiple of them of the words sent there; one word may have more.
CELL_LETTERS, MORE_SEARCHING = 1 << 18, 8
LEAF = 128
#: Words that search a tree at once.
SEARCHED = 1 << 14
#: Differences of letter counts computed at once.
BLOCK = 1 << 19
_ONES = np.ones(LETTERS + OTHERS, np.float32)

Rewrite = Callable[[object, str], str]


# Words and how often they occur


def _counter(pattern: str, min_letters: int, rewrite: Rewrite | None):
    runs = re.compile(pattern)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.ascii_lower(batch.column("text"))):
                own = Counter(runs.findall(text.as_py() or ""))
                for word, n in own.items():
                    total[rewrite(doc_id, word) if rewrite else word] += n
            words = [w for w in total if len(w) >= min_letters]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    return counted


def word_counts(docs: DataFrame, pattern: str, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, rewrite: Rewrite | None = None) -> DataFrame:
    """word, n: the runs of ``pattern`` in all texts, A-Z lower-cased, that are long and frequent enough.

    ``rewrite`` gets a row's doc_id and one of its words and returns the word to count.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counter(pattern, min_letters, rewrite), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Points


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def points(words: list[str]) -> np.ndarray:
    """Letter counts, at most 255 each: cutting them off brings points nearer, never apart."""
    codes, first = letters(words)
    low = codes - np.uint32(ord("a"))
    dimension = np.where(low < LETTERS, low, LETTERS + codes % OTHERS).astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.diff(first))
    width = LETTERS + OTHERS
    counts = np.bincount(word * width + dimension, minlength=len(words) * width)
    return np.minimum(counts, 255).astype(np.int16).reshape(len(words), width)


def _plane(at: np.ndarray) -> tuple[int, int] | None:
    """The dimension and highest lower value that split the points most evenly; None if all are equal."""
    best, found = 0, None
    for d in np.flatnonzero(at.min(axis=0) < at.max(axis=0)).tolist():
        upto = np.cumsum(np.bincount(at[:, d]))
        even = np.minimum(upto, len(at) - upto)[:-1]
        value = int(even.argmax())
        if even[value] > best:
            best, found = int(even[value]), (d, value)
    return found


# Cells


@dataclass
class Planes:
    """The upper levels of a length's tree: [dimension, value, lower child, upper child], or [-1, cell, 0, 0]."""

    nodes: list[list[int]] = field(default_factory=list)
    cells: int = 0

    def grow(self, sample: np.ndarray, cells: int) -> int:
        own = len(self.nodes)
        plane = _plane(sample) if cells > 1 and len(sample) >= 2 * PER_CELL else None
        if plane is None:
            self.nodes.append([-1, self.cells, 0, 0])
            self.cells += 1
            return own
        self.nodes.append([*plane, 0, 0])
        low = sample[:, plane[0]] <= plane[1]
        part = max(1, min(cells - 1, round(cells * low.mean())))
        self.nodes[own][2] = self.grow(sample[low], part)
        self.nodes[own][3] = self.grow(sample[~low], cells - part)
        return own

    def reached(self, at: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each cell, and which points may have others within ``radius`` in it."""
        waiting = [(0, np.arange(len(at)), np.zeros(at.shape, np.int16))]
        while waiting:
            node, who, gap = waiting.pop()
            if not len(who):
                continue
            d, value, low, high = self.nodes[node]
            if d < 0:
                yield value, who
                continue
            # the gap to the half space, in this dimension: planes above may have asked for more
            for child, beyond in ((low, at[who, d] - value), (high, value + 1 - at[who, d])):
                further = gap.copy()
                further[:, d] = np.maximum(gap[:, d], beyond)
                near = further.sum(axis=1) <= radius
                waiting.append((child, who[near], further[near]))


def learned_planes(words: DataFrame, cell_letters: int = CELL_LETTERS) -> dict[int, Planes]:
    """Planes of each length that needs more than one cell; a length's share of the sample is its share of the letters."""
    sizes = words.groupBy("size").count().where(F.col("size") * F.col("count") > cell_letters)
    sizes = {r["size"]: r["count"] for r in sizes.collect()}  # lengths of many words
    planes = {}
    if not sizes:
        return planes
    part = min(1.0, SAMPLE / sum(sizes.values()))
    drawn = words.where(F.col("size").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))))
    by_size: dict[int, list[str]] = {}
    for row in drawn.select("size", "word").orderBy("word").limit(SAMPLE + SAMPLE // 10).collect():
        by_size.setdefault(row["size"], []).append(row["word"])
    for size, sample in by_size.items():
        planes[size] = Planes()
        planes[size].grow(points(sample), -(-size * sizes[size] // cell_letters))
    return planes


def _router(planes: dict[int, Planes]):
    """Sends each word as a point to its cell, and as a search to the cells in reach, of its length and those next to it."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                table = batch.take(pa.array(own))
                at = points(table.column("word").to_pylist())
                for other in (size - 1, size, size + 1):
                    tree = planes.get(other)
                    for search in (False, True):
                        if not search and other != size:
                            continue
                        radius = 0 if not search else 2 if other == size else 1
                        for cell, who in tree.reached(at, radius) if tree else [(0, np.arange(len(at)))]:
                            rows = table.take(pa.array(who))
                            n = rows.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(n, other), pa.int32()), pa.array(np.full(n, cell), pa.int32()),
                                    pa.array(np.full(n, search)), rows.column("word"), rows.column("n"),
                                ],
                                ["length", "cell", "search", "word", "n"],
                            )

    return routed


# Search in a cell


class Tree:
    """A k-d tree: node k has the points order[first:last], their box, and two children or none."""

    def __init__(self, at: np.ndarray, leaf: int = LEAF):
        self.at, self.order = at, np.arange(len(at))
        self.nodes: list[list] = []
        waiting = [(0, len(at), -1, 0)]
        while waiting:
            first, last, above, side = waiting.pop()
            own = at[self.order[first:last]]
            number = len(self.nodes)
            self.nodes.append([first, last, own.min(axis=0), own.max(axis=0), -1, -1])
            if above >= 0:
                self.nodes[above][4 + side] = number
            plane = _plane(own) if last - first > leaf else None
            if plane:
                low = own[:, plane[0]] <= plane[1]
                self.order[first:last] = np.concatenate([self.order[first:last][low], self.order[first:last][~low]])
                cut = first + int(low.sum())
                waiting += [(first, cut, number, 0), (cut, last, number, 1)]

    def within(self, search: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, point) pairs whose differences are one at most in ``radius`` dimensions (1 or 2), and none elsewhere.

        These are the pairs whose squared differences sum up to the radius at most, which is a product of matrices. Their
        sum of differences is no larger than the radius, so they lie in the boxes that are no further away.
        """
        # small whole numbers, which float32 holds exactly
        exact = [x.astype(np.float32) for x in (search, self.at[self.order])]
        lengths = [(x * x).sum(axis=1) for x in exact]
        boxes = [(low.astype(np.float32), high.astype(np.float32)) for _, _, low, high, *_ in self.nodes]
        waiting = [(0, np.arange(len(search)))]
        while waiting:
            number, who = waiting.pop()
            first, last, _, _, *children = self.nodes[number]
            own = exact[0][who]
            gap = np.clip(own, *boxes[number])
            gap -= own
            who = who[np.abs(gap, out=gap) @ _ONES <= radius[who]]
            if not len(who):
                continue
            if children[0] >= 0:
                waiting += [(c, who) for c in children]
                continue
            for a in range(first, last, LEAF):  # equal points make leaves of any size
                points_here = slice(a, min(a + LEAF, last))
                for b in range(0, len(who), BLOCK // LEAF):
                    part = who[b : b + BLOCK // LEAF]
                    apart = exact[0][part] @ exact[1][points_here].T
                    apart *= -2
                    apart += lengths[0][part][:, None]
                    apart += lengths[1][points_here]
                    i, j = np.nonzero(apart <= radius[part][:, None])
                    yield part[i], self.order[a + j]


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced letter, or by one more in ``x`` if that is longer."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    ahead = np.cumprod(x[:, :-1] == y, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= y.shape[1]


def search_cell(words: list[str], n: np.ndarray, searching: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length and searching words of that length or one more or less: which of them find a word, how many,
    the largest n of these, and the first word that has it."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__))
    words, n = [words[k] for k in order], n[order]
    codes, _ = letters(words)
    codes = codes.reshape(len(words), len(words[0]))
    tree = Tree(points(words))
    found = []
    for at in range(0, len(searching), SEARCHED):
        who, many, best = _nearest(tree, codes, n, searching[at : at + SEARCHED])
        found.append((who + at, many, n[best], order[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest(tree: Tree, codes: np.ndarray, n: np.ndarray, searching: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words find one, how many, and the first of those with the largest n; the tree's words are in order."""
    length = codes.shape[1]
    own_codes, first = letters(searching)
    sizes = np.diff(first)
    hits: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for i, j in tree.within(points(searching), np.where(sizes == length, 2, 1)):
        for size in np.unique(sizes[i]).tolist():
            same = sizes[i] == size
            a, b = i[same], j[same]
            step = max(1, BLOCK // size)
            for k in range(0, len(a), step):
                p, q = a[k : k + step], b[k : k + step]
                x, y = own_codes[first[p][:, None] + np.arange(size)], codes[q]
                near = one_edit(x, y) if size >= length else one_edit(y, x)
                hits.append((p[near], q[near]))
    i, j = (np.concatenate(x) for x in zip(*hits))
    ranked = np.lexsort((j, -n[j], i))
    i, j = i[ranked], j[ranked]
    found, begin, many = np.unique(i, return_index=True, return_counts=True)
    return found, many, j[begin]


def _searched(cell: pa.Table) -> pa.Table:
    search = cell.column("search").to_numpy()
    words, n = cell.column("word").to_pylist(), cell.column("n").to_numpy()
    own, asking = np.flatnonzero(~search), np.flatnonzero(search)
    schema = ["word", "n_near", "best_n", "best"]
    if not len(own) or not len(asking):
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], schema)
    points_words = [words[k] for k in own]
    found, many, best_n, best = search_cell(points_words, n[own], [words[k] for k in asking])
    return pa.table(
        [
            pa.array([words[k] for k in asking[found]], pa.string()), pa.array(many, pa.int64()), pa.array(best_n, pa.int64()),
            pa.array([points_words[k] for k in best], pa.string()),
        ],
        schema,
    )


def near_words(words: DataFrame, stored: Callable[[DataFrame, str], DataFrame], cell_letters: int = CELL_LETTERS) -> DataFrame:
    """word, n_near, best_n, best for the words (word, n, size) that others are one edit away from: how many of them, the
    largest n, and the first word that has it. ``words`` is a stored table of distinct words."""
    sent = words.select("word", "n", "size").mapInArrow(
        _router(learned_planes(words, cell_letters)), "length int, cell int, search boolean, word string, n long"
    )
    sent = stored(sent, "variant-cells")
    full = sent.groupBy("length", "cell", "search").agg(F.sum(F.length("word")).alias("letters"))
    most = F.when(F.col("search"), F.lit(MORE_SEARCHING)).otherwise(F.lit(1)) * cell_letters
    slices = F.ceil(F.col("letters") / most).cast("int")
    full = full.withColumn("slices", slices).where("slices > 1")
    of = {s: full.where(F.col("search") == F.lit(s)).select("length", "cell", F.col("slices").alias(n)) for s, n in ((False, "p"), (True, "s"))}
    # cells with more letters than planned: a row for each of them
    cut = stored(of[False].join(of[True], ["length", "cell"], "full"), "variant-slices")
    sliced = sent.join(cut, ["length", "cell"], "left").na.fill(1, ["p", "s"])
    at = F.pmod(F.xxhash64("word"), F.when(F.col("search"), F.col("s")).otherwise(F.col("p")))
    others = F.sequence(F.lit(0), F.when(F.col("search"), F.col("p")).otherwise(F.col("s")) - 1)
    sliced = sliced.withColumn("own", at).withColumn("other", F.explode(others))
    part = F.when(F.col("search"), F.struct(F.col("other").cast("long").alias("p"), F.col("own").cast("long").alias("s"))).otherwise(
        F.struct(F.col("own").cast("long").alias("p"), F.col("other").cast("long").alias("s"))
    )
    groups = sliced.select("length", "cell", part.alias("part"), "search", "word", "n").groupBy("length", "cell", "part")
    found = groups.applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return stored(found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")), "near-words")


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root of a stored table of (word, form): forms are followed to the last, twice as far in every round."""
    spark = forms.sparkSession
    now = forms.select("word", F.col("form").alias("root"))
    with scope(spark) as stored:
        while True:
            onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
            now = moved.select("word", "root")
            if moved.where("next is not null").isEmpty():
                return materialise(now, "roots", keep=True)


def spelling_variants(
    docs: DataFrame, pattern: str = "[A-Za-z\\u00C0-\\u00FF]+", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    ratio: float = 2, rewrite: Rewrite | None = None, cell_letters: int = CELL_LETTERS,
) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of all texts of ``docs``.

    Words are the runs of ``pattern``, A-Z lower-cased, with at least ``min_letters`` code points that occur ``min_count``
    times or more (n) in all texts. Two words are near if one inserted, deleted or replaced code point makes them equal.
    form: the near word with the largest n, of equal ones the first by code points, if its n is at least ``ratio`` (above
    1) times the word's; form_n: its n; root: where forms lead, or the word itself. Null and empty texts have no words;
    repeated rows count as often as they occur; ids may be null or repeat; other columns are not looked at; an empty table
    gives no rows. A batch of texts and a cell are held by a task, a word of any length among them.
    """
    if ratio <= 1:
        raise ValueError("forms must have more occurrences than their variants")
    counted = word_counts(docs, pattern, min_letters, min_count, rewrite).withColumn("size", F.length("word"))
    with scope(docs.sparkSession) as stored:
        words = stored(counted, "words")
        near = near_words(words, stored, cell_letters)
        formed = words.join(near, "word", "left").withColumn("has", F.col("best_n") >= F.lit(ratio) * F.col("n"))
        formed = materialise(
            formed.select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n"),
            ),
            "forms",
            keep=True,
        )
    roots = _rooted(formed.where("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
