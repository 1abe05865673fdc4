"""The operators once more, written for few rows: rows are (doc_id, text) pairs."""

import collections
import hashlib
import math
import re
import zlib

BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def in_order(rows):
    """Null ids last; rows of one id stay in the given order."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def contamination(rows, items, size=13):
    words = lambda s: re.findall(ALNUM, lowered(s))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        width = min(size, len(w))
        for k in range(len(w) - width + 1 if width else 0):
            windows[tuple(w[k : k + width])].add("null" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for width in {len(k) for k in windows}:
            for k in range(len(w) - width + 1):
                if own := windows.get(tuple(w[k : k + width])):
                    hit |= set(range(k, k + width))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_scores(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda s: [*re.findall(BLANK, lowered(s)), None]
    counts = collections.Counter(t for d, s in rows if not held(d) for t in tokens(s))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, s in rows:
        own = tokens(s)
        score = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out.append((d, held(d), len(own), sum(counts[t] > 0 for t in own), n, round(score, 5)))
    return out


def components(rows, size, percent):
    """(doc_id, shingles, component_id), with all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall(BLANK, lowered(text))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    first = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return [(d, len(sets[i]), first[root(i)]) for i, (d, _) in enumerate(rows)]


def line_dedup(rows, run_words=25):
    """(doc_id, lines, removed, text): every run of every text is looked at."""
    place = {}
    texts = []
    for number, (d, text) in enumerate(in_order(rows)):
        lines = (text or "").split("\n")
        full = [i for i, line in enumerate(lines) if re.search(BLANK, line)]
        keys = [lines[i].strip(" \t\n\x0b\x0c\r") for i in full]
        runs = []
        for a in range(len(keys)):
            words = 0
            for b in range(a, len(keys)):
                words += len(re.findall(BLANK, keys[b]))
                if words >= run_words:
                    runs.append((tuple(keys[a : b + 1]), a, b))
        own = place.setdefault((d, text), number)
        for key, a, _ in runs:
            place.setdefault(key, (own, a))
        texts.append((d, text, own, lines, full, runs))
    out = []
    for d, text, own, lines, full, runs in texts:
        gone = set()
        for key, a, b in runs:
            if place[key] < (own, a):
                gone |= set(range(full[a], full[b] + 1))
        out.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text))
    return out


def repeated_strings(rows, length=100):
    seen, out = set(), []
    for d, text in in_order(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(data[i : i + length])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def counts(rows):
    """(doc_id, words, word characters, symbols, repeated lines, repeated words, base_failed)."""
    out = []
    for d, text in rows:
        text = text or ""
        w = re.findall(BLANK, text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(BLANK, x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed))
    return out


def repeating_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def word_runs(words, min_words=12):
    """(start, length, period): all stretches with equal words q apart, the smallest q of equal stretches."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= min_words:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_runs(rows, rewrite=repeating_tail):
    out = []
    for doc, text in rows:
        words = rewrite(doc, re.findall(BLANK, text or ""))
        runs = word_runs(words)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        out.append((doc, len(runs), *best, milli, *(hashlib.sha256(s.encode()).hexdigest() for s in (lines, kept))))
    return out


def one_edit(x, y):
    if len(x) < len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(x) == len(y) + 1 and any(x[:k] + x[k + 1 :] == y for k in range(len(x)))


def spelling_variants(rows, planted=True):
    """(word, form, root, n, n_near, form_n), with all pairs of words compared."""
    counts = collections.Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = lowered(word)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if planted and doc is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out
