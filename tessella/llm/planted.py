"""What the queries put into the words of the given tables, so that there is something rare to be found in them."""

from __future__ import annotations

import zlib


def repeating_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Of each tenth document, by the crc32 of its id, the words from some place on repeat the first of them."""
    if doc_id is None or not words:
        return words
    group, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    start = group % len(words)
    period = 1 + (len(words) - start) // (3 + group % 8)
    head = words[start : start + period]
    times = -(-(len(words) - start) // period)
    return words[:start] + (head * times)[: len(words) - start]


def missing_letter(doc_id: object, word: str) -> str:
    """A word without one letter, if 97 divides the crc32 of doc_id:word."""
    if doc_id is None:
        return word
    code = zlib.crc32(f"{doc_id}:{word}".encode())
    if code % 97:
        return word
    at = code % len(word)
    return word[:at] + word[at + 1 :]
