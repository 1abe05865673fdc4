"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a longest stretch of words in which words q apart are identical, q the smallest such number, and which holds q
twice. The suffix automaton of a text gives the tree of its suffix links; the strings that end at a word are the path
from the word's state to the root. Words are appended one by one: access to the word's state makes its path the preferred
one and gives it the word's number as colour, so that a state's colour is always the last place where its strings ended.
The path consists of few segments that had one colour each. If the colour of the strings of q words was q words ago, the
last 2 * q words are a square; the strings of q words lie in one segment, whose shortest and longest strings say whether
q is within. A later occurrence would show a shorter period, so every square found this way has the smallest one. Squares
of one period that end at neighbouring words make a run.

Only stretches where a run can be are looked at: a run of m words or more has at least m / 2 words that occur again one
period later, hence every word of it lies in some sequence of m / 2 words that occurs twice in the text. Sequences are
compared by exact numbers and not by hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import covered

MIN_WORDS = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of the suffix automaton of ``words``: link and longest length of each state, and the state of each prefix."""
    link, length, moves, prefix = [-1], [0], [{}], []
    last = 0
    for word in words:
        state = len(link)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = state
            at = link[at]
        if at >= 0:
            old = moves[at][word]
            if length[old] == length[at] + 1:
                link[state] = old
            else:
                copy = len(link)
                link.append(link[old])
                length.append(length[at] + 1)
                moves.append(dict(moves[old]))
                while at >= 0 and moves[at].get(word) == old:
                    moves[at][word] = copy
                    at = link[at]
                link[old] = link[state] = copy
        prefix.append(state)
        last = state
    return link, length, prefix


class Paths:
    """A tree as coloured paths, each a splay tree in the order of depth; a path's colour is kept at the splay tree's root.

    ``up`` is the parent within the splay tree, and at its root the tree's node above the path.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.shallow, self.deep = list(parent), [-1] * n, [-1] * n
        self.colour = [-1] * n

    def _splay(self, x: int) -> None:
        up, shallow, deep, colour = self.up, self.shallow, self.deep, self.colour
        while True:
            y = up[x]
            if y < 0 or (shallow[y] != x and deep[y] != x):
                return
            z = up[y]
            inner = z >= 0 and (shallow[z] == y or deep[z] == y)
            if not inner:
                colour[x] = colour[y]
            # x above y, after y above z where both lean to one side
            turns = (y, x) if inner and (shallow[z] == y) == (shallow[y] == x) else (x, x) if inner else (x,)
            if inner and not self._inside(z):
                colour[x] = colour[z]
            for node in turns:
                above = up[node]
                top = up[above]
                if shallow[above] == node:
                    moved = shallow[above] = deep[node]
                    deep[node] = above
                else:
                    moved = deep[above] = shallow[node]
                    shallow[node] = above
                if moved >= 0:
                    up[moved] = above
                if top >= 0:
                    if shallow[top] == above:
                        shallow[top] = node
                    elif deep[top] == above:
                        deep[top] = node
                up[node], up[above] = top, node

    def _inside(self, x: int) -> bool:
        y = self.up[x]
        return y >= 0 and (self.shallow[y] == x or self.deep[y] == x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Makes the path from ``node`` to the root one of the given colour. (deepest node, colour before) of its segments."""
        segments, below, at = [], -1, node
        while at >= 0:
            self._splay(at)
            segments.append((at, self.colour[at]))
            cut = self.deep[at]
            if cut >= 0:
                self.colour[cut] = self.colour[at]
            self.deep[at] = below
            below, at = at, self.up[at]
        self._splay(node)
        self.colour[node] = colour
        return segments


def runs_of(words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_words`` words, by start, then period."""
    link, length, prefix = suffix_links(words)
    paths = Paths(link)
    found, growing = [], {}
    for end, state in enumerate(prefix):
        segments = paths.access(state, end)
        shorter = [length[deepest] for deepest, _ in segments[1:]] + [0]
        for (deepest, before), least in zip(segments, shorter):
            period = end - before
            if before < 0 or not least < period <= length[deepest]:
                continue
            own = growing.get(period)
            if own and own[1] == end - 1:
                own[1] = end
            else:
                growing[period] = own = [end, end]
                found.append((period, own))
    runs = [(first - 2 * period + 1, last - first + 2 * period, period) for period, (first, last) in found]
    return sorted((r for r in runs if r[1] >= min_words), key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Parts (from, to) outside of which no word is in a run."""
    size = (min_words + 1) // 2
    if len(ids) < max(min_words, 2):
        return []
    grams, width = ids, 1
    while width < size:
        step = min(width, size - width)
        # numbers of the sequences of width + step words
        both = grams[: len(grams) - step] * (grams.max() + 1) + grams[step:]
        distinct, grams = np.unique(both, return_inverse=True)
        if len(distinct) == len(grams):
            return []
        width += step
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    inside = np.zeros(len(ids) + 2, bool)
    inside[1:-1] = covered(again, again + width, len(ids))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= min_words]


def text_runs(words: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for a, b in stretches(ids, min_words):
        found += [(a + start, length, period) for start, length, period in runs_of(ids[a:b].tolist(), min_words)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that repeat a run's first period."""
    if not runs:
        return words
    start, length, period = np.array(runs).T
    gone = covered(start + period, start + length, len(words))
    return [w for w, g in zip(words, gone) if not g]


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _searcher(min_words: int, rewrite: Rewrite | None):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist() if rewrite else [None] * batch.num_rows
            counts, runs, kept = [], [], []
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()  # of bytes: at \x20 and \x09 to \x0D
                if rewrite:
                    words = rewrite(doc_id, words)
                own = text_runs(words, min_words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                kept.append(b" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)),
                    pa.array(kept, pa.binary()).view(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    return searched


def word_runs(docs: DataFrame, min_words: int = MIN_WORDS, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), text for every row of ``docs``.

    Words are what blanks (\\x20 and \\x09 to \\x0D) leave, numbered from 0, and compared byte by byte. A run has at least
    ``min_words`` words. text: the words joined by one space, without those that a run holds behind its first period.
    ``rewrite`` gets a row's doc_id and words and returns the words to look at. Null and empty texts have no words, no
    runs and an empty text. Rows are looked at one by one, so ids may be null or repeat and equal rows get equal results;
    other columns are not looked at; an empty table gives no rows. A text is held by one task, with the states of its
    longest stretch of repeated sequences, some 600 bytes a word.
    """
    if min_words < 2:
        raise ValueError("a run has two words at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _searcher(min_words, rewrite),
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string",
    )
