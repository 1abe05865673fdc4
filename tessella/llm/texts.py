"""Texts of Arrow batches as byte arrays: words, lines and hashes of spans, for a slab of documents at once.

The hash of a span is its polynomial modulo the prime 2**61 - 1, which comes from two running sums, and a finalizer on
top. The base is drawn from a seeded generator, the same in every task; it knows nothing of the texts. Equal spans have
equal hashes; two different ones of at most n bytes share one for at most n of the 2**61 bases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slab of its own.
SLAB = 1 << 20

PRIME = (1 << 61) - 1
_P, _LOW32, _LOW31, _LOW30 = (np.uint64((1 << k) - 1) for k in (61, 32, 31, 30))
_BASE = int(np.random.default_rng(20240229).integers(1 << 60, PRIME - 1))
_BACK = pow(_BASE, -1, PRIME)
_SALT = np.uint64(0xD6E8FEB86659FD93)
#: Numbers multiplied at once: their intermediate results stay in the cache.
_AT_ONCE = 1 << 13


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first : last + 1] = True
    return found


#: Bytes of the words [^\x20\x09-\x0D]+ and, after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LETTER_OR_DIGIT = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, from halves of 31 bits: 2**61 is one."""
    found = np.empty(len(a), np.uint64)
    for at in range(0, len(a), _AT_ONCE):
        x, y = a[at : at + _AT_ONCE], b[at : at + _AT_ONCE]
        x_high, y_high = x >> np.uint64(31), y >> np.uint64(31)
        x, y = x & _LOW31, y & _LOW31
        middle = x_high * y + x * y_high
        x_high *= y_high
        x *= y
        x += x_high << np.uint64(1)
        x += middle >> np.uint64(30)
        x += (middle & _LOW30) << np.uint64(31)
        found[at : at + _AT_ONCE] = _reduced(x)
    return found


@cache
def powers(base: int) -> np.ndarray:
    """The first SLAB powers of a base."""
    found = np.ones(1, np.uint64)
    while len(found) < SLAB:
        factor = np.uint64(pow(base, len(found), PRIME))
        found = np.concatenate([found, times(found, np.full(len(found), factor))])
    return found


def _power_at(base: int, place: np.ndarray) -> np.ndarray:
    low = powers(base)[place & (SLAB - 1)]
    most = int(place.max()) // SLAB if len(place) else 0
    if not most:
        return low
    high = np.array([pow(base, k * SLAB, PRIME) for k in range(most + 1)], np.uint64)
    return times(low, high[place // SLAB])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _running(n: int, terms: Callable[[slice, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Running sums modulo PRIME, from 0. ``terms`` gives the low 32 bits and the rest of the terms of some places, or
    numbers below 2**43 that stand for them."""
    sums = np.zeros(n + 1, np.uint64)
    powers_of_base = powers(_BASE)
    for at in range(0, n, _AT_ONCE):
        places = slice(at, min(n, at + _AT_ONCE))
        first = at % SLAB
        power = powers_of_base[first : first + places.stop - at]
        if at >= SLAB:
            power = times(power, np.full(len(power), np.uint64(pow(_BASE, at - first, PRIME))))
        low, high = terms(places, power)
        low, high = np.cumsum(low), _reduced(np.cumsum(high))
        total = (low & _P) + (low >> np.uint64(61))
        total += (high << np.uint64(32)) & _P
        total += high >> np.uint64(29)
        total += sums[at]
        sums[at + 1 : places.stop + 1] = _reduced(total)
    return sums


def running(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers of the base."""

    def terms(places: slice, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        product = times(_reduced(values[places]), power)
        return product & _LOW32, product >> np.uint64(32)

    return _running(len(values), terms)


def running_bytes(data: np.ndarray) -> np.ndarray:
    """``running`` of the bytes, each one more than it is."""

    def terms(places: slice, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digits = data[places].astype(np.uint64)
        digits += np.uint64(1)
        high = power >> np.uint64(32)
        high *= digits
        digits *= power & _LOW32
        return digits, high

    return _running(len(data), terms)


def _spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return times(_reduced(sums[end] + _P - sums[start]), _power_at(_BACK, start))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(_spans(sums, start, end) + (end - start).astype(np.uint64) * _SALT)


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` values, by its first place."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    start = np.arange(len(values) - size + 1)
    return span_hash(running(mix(values)), start, start + size)


def of_document(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a document."""
    return mix(values + doc.astype(np.uint64) * _SALT)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more; whether it occurs earlier."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys) + 1, bool)
    again[1:-1] = keys[order[1:]] == keys[order[:-1]]
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = again[:-1] | again[1:]
    earlier[order] = again[:-1]
    return twice, earlier


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


@dataclass
class Slab:
    """Bytes of the documents ``first`` to ``last`` of a batch; document k is data[bounds[k]:bounds[k + 1]]."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    inside: np.ndarray | None = field(default=None, repr=False)

    @property
    def n(self) -> int:
        return self.last - self.first

    @cached_property
    def sums(self) -> np.ndarray:
        return running_bytes(self.data)

    def parts(self, limit: int = SLAB) -> Iterator[tuple[int, Slab]]:
        """Slabs of a few documents each, and the place of each one's first byte in this one."""
        first = 0
        while first < self.n:
            last = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + limit, "right")) - 1)
            a, b = self.bounds[first], self.bounds[last]
            yield int(a), Slab(first, last, self.data[a:b], self.bounds[first : last + 1] - a)
            first = last

    def totals(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each document."""
        upto = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=upto[1:])
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that do not cross documents: start, end, document."""
        self.inside = inside
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.bounds, start, "right") - 1

    def words(self, kind: np.ndarray) -> Words:
        start, end, doc = self.runs(kind[self.data])
        return Words(span_hash(self.sums, start, end), doc, np.searchsorted(doc, np.arange(self.n + 1)), start, end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines split by \\n: start, end, document. A document has one line more than it has \\n."""
        breaks = np.flatnonzero(self.data == 0x0A)
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.bounds, breaks, "right") - 1])
        start = np.concatenate([self.bounds[:-1], breaks + 1])
        end = np.concatenate([self.bounds[1:], breaks])
        end_doc = doc
        by_start, by_end = np.lexsort((start, doc)), np.lexsort((end, end_doc))
        return start[by_start], end[by_end], doc[by_start]


@dataclass
class Words:
    """Words of a slab: hash and document of each, and the place of each document's first word."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of ``size`` words within a document: place of the first word, hash."""
        hashes = window_hash(self.hash, size)
        whole = self.doc[: len(hashes)] == self.doc[size - 1 :] if len(hashes) else np.zeros(0, bool)
        return np.flatnonzero(whole), hashes[whole]


def slabs(texts: pa.Array | pa.ChunkedArray, lower_case: bool = False, limit: int = SLAB) -> Iterator[Slab]:
    """The texts of a column in slabs; null is empty."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        yield from _slabs(part, lower_case, limit)


def _slabs(texts: pa.Array, lower_case: bool, limit: int) -> Iterator[Slab]:
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, first + (1 << 16), len(texts))
        own = data[offsets[first] : offsets[last]]
        yield Slab(first, last, lower(own) if lower_case else own, offsets[first : last + 1] - offsets[first])
        first = last
