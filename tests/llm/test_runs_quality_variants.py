"""Periodic runs, quality by a network and spelling variants against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tessella.llm import language, quality_net, variants
from tessella.llm.planted import missing_letter
from tessella.llm.quality_net import BLOCK, PER_CHUNK, PER_WIDTH, STEP, TAPS, WIDTHS, classify_quality
from tessella.llm.queries import QUERIES
from tessella.llm.texts import slabs
from tessella.llm.variants import Tree, one_edit, points, spelling_variants
from tessella.llm.word_runs import Paths, runs_of, stretches, suffix_links, text_runs, word_runs
from test_corpus_operators import LARGER, ODD, PAIRS, SMALL, as_set, documents, nothing, odd  # noqa: F401

RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def some_words(rng):
    kinds = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(kinds) for _ in range(rng.randint(0, 90))]
    if rng.random() < 0.5:
        at, part = rng.randint(0, len(words)), words[: rng.randint(1, 9)]
        words[at:at] = part * rng.randint(2, 9)
    return words


# -- periodic runs


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        words, least = some_words(rng), rng.choice([2, 3, 4, 7, 12, 13])
        want = brute.word_runs(words, least)
        assert runs_of(words, least) == want == text_runs([b"%d" % w for w in words], least)
        inside = {k for a, b in stretches(np.array(words, np.int64), least) for k in range(a, b)}
        assert all(k in inside for a, n, _ in want for k in range(a, a + n))


def test_access_recolours_the_whole_path():
    rng = random.Random(2)
    for _ in range(60):
        parent = [-1, *(rng.randrange(k) for k in range(1, 60))]
        paths, colour = Paths(parent), [-1] * 60
        for step in range(80):
            node = at = rng.randrange(60)
            seen = []
            while at >= 0:
                if not seen or colour[seen[-1][0]] != colour[at]:
                    seen.append((at, colour[at]))
                colour[at], at = colour[at], parent[at]
            found = paths.access(node, step)
            merged = [s for k, s in enumerate(found) if not k or s[1] != found[k - 1][1]]
            assert [c for _, c in merged] == [c for _, c in seen] and (merged[0][0] == node)
            at = node
            while at >= 0:
                colour[at], at = step, parent[at]


def test_links_of_the_automaton():
    words = [0, 1, 0, 0, 1, 2, 0, 1, 0, 1]
    link, length, prefix = suffix_links(words)
    for end, state in enumerate(prefix):
        ends = {n: {k for k in range(len(words)) if n <= k + 1 and words[k + 1 - n : k + 1] == words[end + 1 - n : end + 1]} for n in range(1, end + 2)}
        while state > 0:  # all strings of a state end at the same places
            assert len({frozenset(ends[n]) for n in range(length[link[state]] + 1, length[state] + 1)}) == 1
            state = link[state]


def test_periodic_runs_of_the_given_texts(spark):
    _, rows = documents(spark, SMALL)
    found = QUERIES["op11_periodic_runs"](spark, SMALL).select(RUN_COLUMNS).collect()
    want = brute.periodic_runs(rows)
    assert as_set(found) == as_set(want) and sum(r[1] > 0 for r in want) > 10


def test_periodic_runs_of_odd_rows(odd, nothing):  # noqa: F811
    short = [(d, t) for d, t in PAIRS if len(t or "") < 50_000]
    found = {(r["doc_id"], r["n_words"]): r for r in word_runs(odd).collect()}
    for doc, text in short:
        words = (text or "").encode().split()
        own = found[doc, len(words)]
        runs = brute.word_runs(words)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        assert [tuple(r) for r in own["runs"]] == runs
        assert own["text"].encode() == b" ".join(w for k, w in enumerate(words) if k not in gone)
    assert word_runs(odd).count() == len(ODD)
    assert word_runs(nothing).collect() == []
    with pytest.raises(ValueError):
        word_runs(odd, min_words=1)


def test_runs_of_long_texts():
    rng = random.Random(3)
    period = [rng.randrange(900) for _ in range(700)]
    words = [1000 + rng.randrange(2) for _ in range(15_000)] + period * 20 + [5] * 9000
    found = runs_of(words)
    assert (15_000, 14_000, 700) in found and any(n >= 9000 and q == 1 for _, n, q in found)


# -- quality


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(4)
    windows = rng.integers(97, 123, (256, PER_CHUNK * BLOCK + TAPS - 1), dtype=np.uint8)
    target = np.arange(256) % 2
    windows[target == 0, 40:44] = np.frombuffer(b"#!#!", np.uint8)
    net = quality_net.train(windows, target, epochs=15)
    net.combine = np.array([0.5, 0.3, 0.2, 0.1])
    return net, windows, target


def test_the_network_learns(trained):
    net, windows, target = trained
    texts = pa.array([w.tobytes() for w in windows], pa.binary())
    lowest = np.concatenate([net.text_sums(s)[:, 1] for s in slabs(texts)])
    assert ((lowest > 0) == target).mean() > 0.9


def plain_score(net, text):
    """One document, chunk by chunk, place by place."""
    size = len(text) + TAPS - 1
    blocks = -(-size // BLOCK)
    chunks = 1 + max(0, -(-(blocks - PER_CHUNK) // STEP))
    data = [0] * (TAPS - 1) + list(text)
    data += [0] * ((STEP * chunks + PER_CHUNK) * BLOCK + TAPS - len(data))
    seen = net.embedding[data]
    sums = []
    for k in range(chunks):
        kept = []
        for width, filters in zip(WIDTHS, net.filters):
            places = range(k * STEP * BLOCK, (k * STEP + PER_CHUNK) * BLOCK)
            kept.append(np.max([seen[p : p + width].reshape(-1) @ filters for p in places], axis=0))
        sums.append(np.maximum(np.concatenate(kept) + net.bias, 0) @ net.weights + net.base)
    return 1 / (1 + np.exp(-np.array([np.mean(sums), min(sums), max(sums), 1]) @ net.combine))


def test_scores_equal_a_plain_forward_pass(trained):
    net, _, _ = trained
    rng = random.Random(5)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 59, 60, 61, 187, 252, 253, 256, 700, 3000)]
    for order in (texts, texts[::-1], texts[3:4]):
        found = np.concatenate([net.scores(s) for s in slabs(pa.array(order, pa.binary()))])
        assert np.allclose(found, [plain_score(net, t) for t in order], atol=1e-4)
    assert len(net.bias) == PER_WIDTH * len(WIDTHS)


def test_quality_of_held_out_documents(spark):
    found = {r["doc_id"]: r for r in QUERIES["op12_quality_net"](spark, LARGER).collect()}
    truth = spark.read.parquet(f"{LARGER}/labels.parquet").collect()
    held = [r for r in truth if found[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and len(found) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert sum(found[r["doc_id"]]["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_quality_of_odd_rows(spark, odd, nothing):  # noqa: F811
    rows = [(r[0], k % 2, 0) for k, r in enumerate(ODD)] + [(None, 1, 0), (7, None, 0), (99, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    found = classify_quality(odd, labels).collect()
    assert len(found) == len(ODD) and found[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by_text = {}
    texts = dict(PAIRS)
    for r in found:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(max(s) - min(s) < 1e-5 and 0 <= min(s) <= 1 for s in by_text.values())
    assert classify_quality(nothing, labels).collect() == []
    assert {r["score"] for r in classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in classify_quality(odd, labels.where("quality = 1")).collect()} == {1.0}


def test_held_out_labels_are_not_learned_from(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    import zlib

    learned = {r["doc_id"] for r in quality_net.learning_rows(labels).collect()}
    assert learned == {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}


# -- language: the same for its network


def plain_language(net, text):
    data = [0] * language.LEAD + list(text)
    windows = -(-len(data) // language.STEP)
    data += [0] * (windows * language.STEP + language.LEAD - len(data))
    total = np.zeros(len(net.labels))
    for k in range(windows):
        seen = net.embedding[data[k * language.STEP : k * language.STEP + language.WINDOW]]
        answers = [
            np.max([sum(seen[p + t] @ net.filters[t][:, f] for t in range(len(net.filters))) for p in range(language.STEP)])
            for f in range(len(net.bias))
        ]
        probability = language.softmax((np.maximum(np.array(answers) + net.bias, 0) @ net.out + net.base)[None])[0]
        inside = sum(language.LEAD <= p < language.LEAD + len(text) for p in range(k * language.STEP, (k + 1) * language.STEP))
        total += probability * inside
    return total / len(text)


def test_languages_equal_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    windows = rng.integers(97, 123, (64, language.WINDOW), dtype=np.uint8)
    net = language.train(windows, ["a", "b"], np.arange(64) % 2, epochs=1)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 186, 187, 400)]
    for order in (texts, texts[::-1]):
        batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in order])], ["text"])
        found = next(language._predictor(net, [])(iter([batch])))
        want = [plain_language(net, t) for t in order]
        assert np.allclose(found.column("score"), [w.max() for w in want], atol=1e-4)
        assert found.column("lang_pred").to_pylist() == [net.labels[w.argmax()] for w in want]


# -- spelling variants

VARIANT_COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("cell_letters", [variants.CELL_LETTERS, 300])
def test_variants_of_the_given_texts(spark, monkeypatch, cell_letters):
    monkeypatch.setattr(variants, "PER_CELL", 2)
    docs, rows = documents(spark, SMALL)
    want = brute.spelling_variants(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    found = spelling_variants(docs, rewrite=missing_letter, cell_letters=cell_letters)
    assert as_set(found.select(VARIANT_COLUMNS).collect()) == as_set(want)
    if cell_letters == variants.CELL_LETTERS:
        assert as_set(QUERIES["op13_spelling_variants"](spark, SMALL).select(VARIANT_COLUMNS).collect()) == as_set(want)


def test_variants_of_odd_rows(spark, odd, nothing):  # noqa: F811
    assert spelling_variants(nothing).collect() == []
    found = spelling_variants(odd).select(VARIANT_COLUMNS)
    assert as_set(found.collect()) == as_set(brute.spelling_variants(PAIRS, planted=False))
    with pytest.raises(ValueError):
        spelling_variants(odd, ratio=1)


def test_variants_of_long_and_equal_words(spark):
    """Words of the same letters, a chain of forms, ties, and long words, in cells of a few words."""
    rng = random.Random(7)
    letters = list("abcdefgh")
    words = ["".join(rng.sample(letters, 8)) for _ in range(150)] + ["x" * 700, "x" * 701, "x" * 350 + "y" + "x" * 349]
    words += ["chain", "chains", "chainss", "chainsss", "étoile", "etoile", "ÀÀÀÀÀ", "àÀÀÀÀ"]
    rows = [(k, " ".join([w] * rng.choice([1, 2, 3, 4, 6, 12, 30]))) for k, w in enumerate(words)]
    rows += [(1000 + k, " ".join([w] * 3 * 2**k)) for k, w in enumerate(["links", "link", "llink", "lllink"])] + [(None, "links Links"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = as_set(brute.spelling_variants(rows, planted=False))
    for cell_letters in (64, 1 << 20):
        assert as_set(spelling_variants(docs, cell_letters=cell_letters).select(VARIANT_COLUMNS).collect()) == want


def test_range_searches_are_exact():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(6)) for _ in range(900)})
    searching = words[::7] + ["abcdef", "aaaaaaa", "zzzzz"]
    at, asked = points(words), points(searching)
    radius = np.array([2 if len(w) == 6 else 1 for w in searching])
    found = {(int(i), int(j)) for a, b in Tree(at, leaf=9).within(asked, radius) for i, j in zip(a, b)}
    apart = np.abs(asked[:, None, :] - at[None]).sum(axis=2)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= radius[:, None]))}


def test_one_edit():
    rng = random.Random(9)
    for _ in range(3000):
        x = "".join(rng.choice("ab") for _ in range(rng.randint(4, 6)))
        y = "".join(rng.choice("ab") for _ in range(rng.randint(len(x) - 1, len(x))))
        got = one_edit(*(np.array([[ord(c) for c in w]], np.uint32) for w in (x, y)))
        assert got[0] == brute.one_edit(x, y), (x, y)
