"""Operators against brute force: on a table of odd rows, on the given tables, and on no rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tessella.llm import chunks, ngram_join, texts
from tessella.llm.components import components
from tessella.llm.decontaminate import contamination, without_contaminated
from tessella.llm.html_text import extract_text, html_to_text
from tessella.llm.language import accepted, dropped_shares, identify_languages
from tessella.llm.lattice import SPACE, Lattice, Vocabulary, read_pieces, score_texts
from tessella.llm.line_dedup import dedup_lines, without_repeated_runs
from tessella.llm.mixing import mix_sources
from tessella.llm.ngram_join import one_of_each, similar_documents, similar_pairs
from tessella.llm.quality import host_quality
from tessella.llm.queries import QUERIES, URL_RULES
from tessella.llm.repeats import repeated_strings
from tessella.llm.session import prepare
from tessella.llm.url_rules import judge_urls, rule_table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgäéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def prose(n, lines=9):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + lines]) for i in range(0, n, lines))


FIRST, SECOND = prose(200), prose(120)
PASSAGE = " ".join(rng.choice(VOCABULARY) for _ in range(60))
NEAR = FIRST.replace(FIRST.split()[50], "changed", 1)
#: A sequence and its complement, which polynomials modulo powers of two do not tell apart.
MORSE = "".join("ab"[k.bit_count() % 2] for k in range(2048))
ESROM = MORSE.translate(str.maketrans("ab", "ba"))
LONG = prose(30_000) + "\n" + PASSAGE + "\n" + FIRST
ODD = [
    (7, FIRST, "en", "a"), (8, FIRST, "en", "a"), (8, FIRST, "en", "a"), (9, NEAR, "en", None), (1, SECOND, "de", "a"),
    (2, "", "de", "b"), (3, None, "de", "b"), (4, " \n\t \n", None, "b"), (5, "word", "en", "b"), (6, "Word", "en", "b"),
    (None, FIRST, "en", None), (None, PASSAGE, "en", "c"), (10, LONG, "en", "a"), (11, "a" * 5000, "en", "a"),
    (12, "x y\n" * 700, "en", "a"), (13, SECOND + "\n\n" + PASSAGE, "de", "a"), (14, "$$ ## 12", "en", "c"),
    (15, "one two", "en", "c"), (16, "ONE two", "en", "c"), (17, PASSAGE + " " + PASSAGE, "en", "a"),
    (19, MORSE, "en", "a"), (20, ESROM, "en", "a"), (21, " ".join(MORSE), "en", "b"), (22, " ".join(ESROM), "en", "b"),
    (23, MORSE + "\n" + ESROM + "\n" + " ".join(ESROM) + "\n" + MORSE[:100], "en", "b"),
    (18, "  " + SECOND.replace("\n", "  \n "), "de", "d"), (-3, "\u00e9\U0001f600 \u00a0 z" * 40, "fr", "d"),
]
CLASHING = (
    "text_key row rest runs label order window chunk bounds data key slice host bucket token set_id keys counts answer size "
    "number weight target level held_out score lang_pred url path verdict stack entries depth place component word"
).split()
ITEMS = [(6, MORSE), (7, " ".join(MORSE[:1500])), (1, PASSAGE), (1, PASSAGE.upper()), (2, "one, two"), (3, ""), (4, None), (None, SECOND[:300]), (5, SECOND[:300])]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = [(*r, len(r[1] or "")) for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


PAIRS = [(r[0], r[1]) for r in ODD]


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def documents(spark, folder):
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_numbers_of_documents_do_not_meet():
    last = chunks.chunk_number((1 << 23) - 1, (1 << 24) - 1)
    assert chunks.row_numbers(last, chunks.MOST)[-1] > 0
    found = [chunks.row_numbers(chunks.chunk_number(p, k), 2).tolist() for p in (0, 1, 65_535, 65_536, 1 << 22) for k in (0, 1, 65_536)]
    assert len({n for own in found for n in own}) == 2 * len(found)
    for p, k in ((1 << 23, 0), (0, 1 << 24)):
        with pytest.raises(OverflowError):
            chunks.chunk_number(p, k)


def test_span_hashes_are_polynomials_modulo_a_prime():
    data = np.random.default_rng(3).integers(0, 256, 2 * texts.SLAB + 50, dtype=np.uint8)
    data[texts.SLAB + 7 : texts.SLAB + 2007] = data[5000:7000]
    sums = texts.running_bytes(data)
    for start, size in ((0, 5), (5000, 2000), (texts.SLAB - 3, 9), (2 * texts.SLAB + 5, 40)):
        value = sum((int(b) + 1) * pow(texts._BASE, k, texts.PRIME) for k, b in enumerate(data[start : start + size])) % texts.PRIME
        assert int(texts._spans(sums, np.array([start]), np.array([start + size]))[0]) == value
    a, b = (texts.span_hash(sums, np.array([at]), np.array([at + 2000])) for at in (5000, texts.SLAB + 7))
    assert a == b
    pair = next(texts.slabs(pa.array([MORSE, ESROM])))
    assert len(set(pair.words(texts.NOT_BLANK).hash.tolist())) == 2


# -- language


def test_languages_of_held_out_documents(spark):
    found = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, LARGER).collect()}
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in truth if found[r["doc_id"]]["held_out"]]
    assert len(found) == len(truth) and len(held) > 200
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_languages_of_odd_rows(odd, nothing):
    rows = identify_languages(odd).collect()
    assert len(rows) == len(ODD)
    named = as_set((r["doc_id"], r["lang_pred"] == "und") for r in rows)
    assert named == as_set((d, not any(c.isalpha() for c in t or "")) for d, t in PAIRS)
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert identify_languages(nothing).collect() == []
    assert {r["lang_pred"] for r in identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert accepted(odd).columns == odd.columns and accepted(odd).count() <= len(ODD) - 4


def test_accepted_keeps_labelled_and_unjudged_texts(spark, odd, nothing):
    docs, _ = documents(spark, SMALL)
    parts = [r["text"][:300] for r in docs.where("length(text) > 300").dropDuplicates(["lang"]).select("text").collect()]
    mixed = docs.limit(30).withColumn("text", F.lit(" ".join(parts))).withColumn("doc_id", -1 - F.col("doc_id"))
    rare = docs.limit(3).withColumns({"lang": F.lit("rare"), "doc_id": -1_000_000_000 - F.col("doc_id")})
    both = docs.unionByName(mixed).unionByName(rare)
    lettered = both.where("text rlike '[\\\\p{L}]'").count()
    assert accepted(both, min_score=0.999).count() == lettered
    assert accepted(odd.withColumn("lang", F.lit(None).cast("string"))).count() == len(ODD) - 4
    assert accepted(nothing).collect() == []
    shares = {r["label"]: r for r in dropped_shares(docs, 2.0).collect()}
    assert shares and all(r["n"] == r["n_below"] and r["share"] == 1 and 0 < r["lowest"] <= 1 for r in shares.values())
    assert dropped_shares(nothing).collect() == []


# -- decontamination


def digest(df):
    sha = F.sha2(F.array_join("items", ","), 256)
    return as_set(df.select("doc_id", "n_words", "n_hit", "n_items", sha, "contaminated").collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_of_odd_rows(spark, odd, nothing, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = brute.contamination(PAIRS, ITEMS)
    assert any(w[-1] for w in want) and digest(contamination(odd, items, block_bytes=block_bytes)) == as_set(want)
    assert digest(contamination(odd, items.limit(0))) == as_set(brute.contamination(PAIRS, []))
    assert contamination(nothing, items).collect() == []
    kept = without_contaminated(odd, items)
    assert kept.columns == odd.columns and as_set(r[:1] for r in kept.collect()) == as_set((w[0],) for w in want if not w[-1])


def test_contamination_with_repeated_and_long_items(spark, odd, monkeypatch):
    """Equal rows are one item, a long item is split, and no block has more windows than asked for."""
    from tessella.llm import decontaminate

    items, taken = [(1, PASSAGE)] * 30 + [(2, LONG), (3, PASSAGE.upper()), (4, SECOND[:300])], []
    whole = decontaminate.item_windows
    monkeypatch.setattr(decontaminate, "item_windows", lambda own, size: taken.append(whole(own, size)) or taken[-1])
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(odd, frame, block_windows=15_000)
    assert digest(found) == as_set(brute.contamination(PAIRS, items))
    assert len(taken) == 3 and all(len(w.sizes) <= 15_000 for w in taken)
    pieces = [(i, t) for i, t in items[:1] * 2]
    assert whole([(str(i), t) for i, t in pieces], 13).items.tolist() == [0] * 48


def test_contamination_of_the_given_tables(spark):
    docs, rows = documents(spark, LARGER)
    items = [tuple(r) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").select("item_id", "text").collect()]
    found = QUERIES["op2_decontamination"](spark, LARGER)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert as_set(found.select(names).collect()) == as_set(brute.contamination(rows, items))


# -- LM scoring


def scored(df):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5)]
    return as_set(df.select(columns).collect())


def test_base_scores(spark, odd, nothing):
    assert scored(score_texts(odd)) == as_set(brute.base_scores(PAIRS))
    assert score_texts(nothing).collect() == []
    _, rows = documents(spark, SMALL)
    found = QUERIES["op3_lattice_score"](spark, SMALL)
    assert scored(found) == as_set(brute.base_scores(rows))
    assert found.where("not (score < 0) or isnan(score) or score < -1e9").count() == 0


def test_lattice_sums_over_all_spellings():
    import numpy as np
    import pyarrow as pa

    from tessella.llm.texts import slabs

    pieces = read_pieces()
    assert math.isclose(np.exp(pieces.weights).sum(), 1)
    text = "the hello wörld 梦 a thonin zzzzz " + "k" * 70
    slab = next(slabs(pa.array([text]), lower_case=True))
    words, lattice = Vocabulary.of(slab), Lattice(pieces)
    found = words.log_probabilities(lattice, slab.data)
    expected = words.expected(lattice, slab.data, np.ones(len(words.hashes)))
    spelled = sum(len(w.encode()) + len(SPACE) for w in text.split())
    assert math.isclose((expected * pieces.sizes).sum(), spelled)  # each way spells each byte once

    from sentencepiece import SentencePieceProcessor

    model, scores = SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model"), {bytes([b]): -math.inf for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = model.id_to_piece(k).encode()
            scores[piece] = max(model.get_score(k), scores.get(piece, -math.inf))
    names = sorted(scores, key=lambda p: (-scores[p], p))
    total = sum(1 / (k + 10) for k in range(len(names)))
    weight = {p: 1 / (k + 10) / total for k, p in enumerate(names)}
    for start, end, log in zip(words.start, words.end, found):
        word = SPACE + slab.data[start:end].tobytes()
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            sums[j] = sum(sums[i] * weight.get(word[i:j], 0) for i in range(max(0, j - 60), j))
        assert math.isclose(math.log(sums[-1]), log, rel_tol=1e-9)


# -- n-gram join


@pytest.mark.parametrize(("size", "percent", "more"), [(3, 90, 8), (5, 80, 2), (1, 50, 2), (2, 100, 8)])
def test_components_of_odd_rows(odd, nothing, monkeypatch, size, percent, more):
    monkeypatch.setattr(ngram_join.similar_sets, "__defaults__", (more,))
    found = similar_documents(odd, size, percent)
    assert as_set(found.select("doc_id", "n_shingles", "component_id").collect()) == as_set(brute.components(PAIRS, size, percent))
    assert similar_documents(nothing, size, percent).collect() == []


@pytest.mark.parametrize(("size", "percent", "more"), [(3, 90, 8), (5, 80, 2)])
def test_components_of_the_given_table(spark, monkeypatch, size, percent, more):
    monkeypatch.setattr(ngram_join.similar_sets, "__defaults__", (more,))
    docs, rows = documents(spark, SMALL)
    found = similar_documents(docs, size, percent).select("doc_id", "n_shingles", "component_id")
    assert as_set(found.collect()) == as_set(brute.components(rows, size, percent))


@pytest.mark.parametrize("more", [2, 8])
def test_chains_and_groups_of_near_copies(spark, monkeypatch, more):
    """Texts that change by a word a step: neighbours are linked, ends are not; and a group around one text."""
    monkeypatch.setattr(ngram_join.similar_sets, "__defaults__", (more,))
    base, rows = prose(120, 200).split(), []
    for k in range(60):
        base = [f"new{k}" if i == (37 * k) % 120 else w for i, w in enumerate(base)]
        rows.append((k, " ".join(base)))
    center = prose(150, 200).split()
    rows += [(100 + k, " ".join([*center[:k], f"own{k}", *center[k + 1 :]])) for k in range(0, 150, 2)]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert as_set(found.select("doc_id", "n_shingles", "component_id").collect()) == as_set(brute.components(rows, 3, 90))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (1, 50)])
def test_similar_pairs_are_all_links(spark, odd, nothing, size, percent):
    chain = prose(60, 200).split()
    near = [(1000 + k, " ".join([*chain[:k], f"own{k}", *chain[k + 1 :]])) for k in range(0, 60, 7)]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(near, "doc_id long, text string"))
    sets = []
    for _, text in PAIRS + near:
        w = re.findall(brute.BLANK, brute.lowered(text))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset())
    links = [
        (x, y) for i, x in enumerate(sets) for y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    found = similar_pairs(docs, size, percent).collect()
    assert sum(r["n_links"] for r in found) == len(links)
    different = [r for r in found if (r["a_id"], r["a_key"]) != (r["b_id"], r["b_key"])]
    assert len(different) == len({frozenset((x, y)) for x, y in links if x != y}) > 0
    assert similar_pairs(nothing, size, percent).collect() == []


def test_one_of_each(spark, odd, nothing):
    kept = one_of_each(odd, 5, 80)
    assert kept.columns == odd.columns and one_of_each(nothing).count() == 0
    groups = {}
    for (d, text), (_, n, component) in zip(PAIRS, brute.components(PAIRS, 5, 80)):
        groups.setdefault(component if n else object(), []).append(d)
    assert as_set((r["doc_id"],) for r in kept.collect()) == as_set((min(g, key=lambda d: (d is None, d or 0)),) for g in groups.values())


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 298)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((298, 299, 300), 298)}


# -- line dedup


def test_line_dedup(spark, odd, nothing):
    named = ["doc_id", "n_lines", "n_removed", "text"]
    pairs = [(d, t) for d, t in PAIRS if d != 10]  # all runs of the very long text are too many for brute force
    found = dedup_lines(odd.where("doc_id is null or doc_id <> 10")).select(named).collect()
    by_key = {(d, t): (n, m, out) for (d, t), (_, n, m, out) in zip(brute.in_order(pairs), brute.line_dedup(pairs)) if d is not None}
    assert len(found) == len(pairs)
    assert as_set(r for r in found if r["doc_id"] is not None) == as_set((d, *by_key[d, t]) for d, t in pairs if d is not None)
    assert dedup_lines(odd).count() == len(ODD) and dedup_lines(nothing).collect() == []
    cleaned = without_repeated_runs(odd)
    assert cleaned.columns == odd.columns and cleaned.where("doc_id = 8").count() == 0 and cleaned.where("doc_id = 3").count() == 1


def test_line_dedup_of_the_given_table(spark):
    docs, rows = documents(spark, SMALL)
    found = dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert as_set(found) == as_set(brute.line_dedup(rows))


# -- repeated strings


def test_repeated_strings(spark, odd, nothing):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = repeated_strings(odd)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    # null ids come last, and of them only the number of removed bytes is fixed
    own = as_set(r for r in found.select(names).collect() if r["doc_id"] is not None)
    want = [w for w in brute.repeated_strings(PAIRS) if w[0] is not None]
    assert own == as_set(want)
    assert [(s["start"], s["end"]) for s in spans[7]] == [] and sum(s["end"] - s["start"] for s in spans[9]) > 0
    assert repeated_strings(nothing).collect() == []


def test_repeated_strings_of_the_given_table(spark):
    docs, rows = documents(spark, SMALL)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = QUERIES["op6_repeated_strings"](spark, SMALL).select(names).collect()
    assert as_set(found) == as_set(brute.repeated_strings(rows))


def test_repeated_strings_across_chunks(spark, monkeypatch):
    """Copies of passages in many chunks, at all offsets, and texts of few different bytes."""
    from tessella.llm import chunks

    monkeypatch.setattr(chunks.chunk_table, "__defaults__", (2000, ()))
    passages = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(10, 50))) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else prose(15) for _ in range(4)]
        rows.append((rng.randint(0, 10_000) * 200 + k, "".join(parts)))
    rows += [(10_000_000 + k, "ab" * rng.randint(40, 200) + "c" * rng.randint(0, 150)) for k in range(20)]
    found = repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert as_set(found.select(names).collect()) == as_set(brute.repeated_strings(rows))


def test_buckets_follow_the_bytes(spark, monkeypatch):
    """More buckets than shuffle partitions for a large table, with equal results."""
    from tessella.llm import chunks

    docs, rows = documents(spark, SMALL)
    table = chunks.chunk_table(docs.select("doc_id", "text"), "test-chunks")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chunks.bucket_count(table) == own
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(chunks, "BUCKET_BYTES", size // (3 * own))
    assert chunks.bucket_count(table) >= 3 * own
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert as_set(repeated_strings(docs).select(names).collect()) == as_set(brute.repeated_strings(rows))
    found = similar_documents(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
    assert as_set(found.collect()) == as_set(brute.components(rows, 3, 90))
    assert scored(score_texts(docs)) == as_set(brute.base_scores(rows))


# -- mixing


def check_mix(rows, most=2):
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= most * r["size"] and sum(r["shard_words"]) == r["taken"]
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 32
    return by_source


def filled(sizes, weights, share, most):
    """Targets by handing the excess on until none is above its bound."""
    target, open_ones, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_ones:
        level = left / sum(weights[i] for i in open_ones)
        full = {i for i in open_ones if most * sizes[i] < level * weights[i]}
        if not full:
            return [level * weights[i] if i in open_ones else target[i] for i in range(len(sizes))]
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ones -= full
    return target


def test_mix_of_the_given_table(spark):
    docs, pairs = documents(spark, LARGER)
    rows = mix_sources(docs).collect()
    texts = dict(pairs)
    assert all(r["size"] == len(re.findall(brute.BLANK, texts[r["doc_id"]])) for r in rows)
    by_source = check_mix(rows)
    names = sorted(by_source)
    want = filled([by_source[s][0]["source_size"] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    assert all(math.isclose(by_source[s][0]["target"], t) for s, t in zip(names, want))
    assert as_set(rows) == as_set(mix_sources(docs.repartition(5)).collect())
    shards = [sum(r["shard_words"][k] for r in rows) for k in range(4)]
    assert max(shards) - min(shards) < 16 * 2 * len(names)


def test_mix_of_odd_rows(odd, nothing):
    rows = mix_sources(odd).collect()
    by_source = check_mix(rows)
    assert len(rows) == len(ODD) and None in by_source
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = filled([by_source[s][0]["source_size"] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    assert all(math.isclose(by_source[s][0]["target"], t) for s, t in zip(names, want))
    assert mix_sources(nothing).collect() == [] and {r["taken"] for r in mix_sources(odd.where("text = ''")).collect()} == {0}


def test_quotas_go_to_the_highest_quotients(spark):
    from tessella.llm.mixing import apportion

    shares = [530.0, 240.0, 230.0, 7.0, 0.0, 1.0, 1.0, 90.5]
    frame = spark.createDataFrame([(float(t), k + 1) for k, t in enumerate(shares)], "target double, number int")
    got = {r["number"]: r["upto"] for r in apportion(frame, 10, 5).collect()}
    seats = round(sum(shares) / 10)
    for shard in range(1, 6):
        quotients = sorted(((-t / (2 * k + 1), i) for i, t in enumerate(shares) for k in range(seats)))[: seats * shard // 5]
        assert [got[i + 1][shard - 1] for i in range(len(shares))] == [sum(j == i for _, j in quotients) for i in range(len(shares))]


# -- html


def test_layout():
    assert html_to_text("<p>One<p>Two <b>bold</b>&amp; more") == "One\n\nTwo bold& more"
    assert html_to_text("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n  4. y\n- c"
    table = "<table><tr><th>Name<th>Qty<tr><td>Apples<td>3<tr><td colspan=2>all of them</table>"
    assert html_to_text(table) == "Name    Qty\nApples  3\nall of them"
    assert html_to_text("<pre> x\n  y</pre>a  \n b") == " x\n  y\n\na b"
    assert html_to_text("<head><title>t</title></head><body>x<div hidden>n</div><i style='display: none'>n</i><!-- n --><script>n</script>") == "x"
    assert html_to_text("a<br>b<br><br>c") == "a\nb\n\nc"
    assert html_to_text("<dl><dt>a<dd>b<dt>c</dl>") == "a\n  b\nc"
    assert html_to_text("1 < 2 &lt; 3 <notatag") == "1 < 2 < 3"
    assert html_to_text("<div>" * 4000 + "deep" + "</div>" * 4000 + " end") == "deep\nend"


def test_layout_keeps_formulas_drawings_and_maps():
    fraction = "<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>+</mo><mi>x</mi></math>"
    assert html_to_text(f"<p>Half {fraction}.") == "Half 1 2+x."
    notes = "<annotation encoding=tex>n</annotation><annotation-xml encoding=text/html>n<p>n</annotation-xml>"
    assert html_to_text(f"<math><semantics><mi>y</mi>{notes}</semantics></math>") == "y"
    assert html_to_text("a<math display=block><mi>x</mi>\n <mo>=</mo> <mn>2</mn></math>b") == "a\nx=2\nb"
    drawing = "<svg><title>n</title><desc>n<p>n</p></desc><defs/><path d='M0 0'/><defs><text>n</text></defs><text>one</text>"
    assert html_to_text(f"<p>See {drawing}<text>t<tspan>wo</tspan><![CDATA[<3]]></text><style/></svg> there") == "See one two<3 there"
    assert html_to_text("<svg><foreignObject><p>in</p></foreignObject></svg><svg><defs><p>out") == "in\n\nout"
    assert html_to_text("Pre<svg>\n <path/>\n</svg>fix <desc>html</desc>") == "Prefix html"
    assert html_to_text("<map name=m><a href=x>North</a> <area href=y><p>South</p></map>") == "North\n\nSouth"


def test_layout_text_ends_head():
    assert html_to_text("<head><title>T</title>Hello<p>there") == "Hello\n\nthere"
    assert html_to_text("<head>\n<title>T</title>\n<meta name=a> <style>n</style>&amp; so on") == "& so on"
    assert html_to_text("<html><head> <script>n</script> </head> <body>x") == "x"


def test_layout_at_any_depth():
    deep = "<font>" * 200
    assert html_to_text(f"{deep}<div hidden><p>n<b>n</b></p></div>x") == "x"
    rows = "<table><tr><td>Apples<td>3<tr><td>Figs<td>10</table>"
    assert html_to_text(f"{deep}{rows}") == "Apples  3\nFigs    10"
    assert html_to_text("<pre>" + "<b>" * 200 + "a  b</b>  c</pre>") == "a  b  c"
    assert html_to_text("<ul>" + "<li><ul>" * 200 + "<li>x").endswith(" - x")
    wide = "<table><tr><td>a<td>" * 3000 + "b"
    assert html_to_text(wide).split() == ["a"] * 3000 + ["b"]
    many = "<div><table><tr><td>" + "<b>" * 30_000 + "</div></p>y" * 30_000
    assert html_to_text(many).count("y") == 30_000
    assert html_to_text("<i>" * 300_000 + "z" + "</i>" * 300_000) == "z"


def test_html_of_odd_rows(spark):
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "plain  text"), (3, "plain  text"), (None, "<p>x"), (4, "<a " + 'x="' * 50_000), (5, "<b>" * 20_000 + "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("clash"), "url": F.lit("clash")})
    want = [(1, ""), (2, ""), (3, "plain text"), (3, "plain text"), (None, "x"), (4, ""), (5, "y")]
    assert as_set(extract_text(pages).collect()) == as_set(want) and extract_text(pages.limit(0)).collect() == []


def test_html_keeps_what_is_visible(spark):
    """Every word of the given pages' paragraphs comes out, in order, and no markup does."""
    found = {r["page_id"]: r["text"] for r in QUERIES["op8_html_text"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        text = " ".join(found[page["page_id"]].split())
        assert "<p>" not in text and "track(" not in text
        for part in re.findall(r"<p>([^<&]+)</p>", page["html"]):
            assert " ".join(part.split()) in text


# -- quality


def test_quality(spark, odd, nothing):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert as_set(host_quality(odd).select(names).collect()) == as_set(brute.counts(PAIRS))
    assert host_quality(nothing).collect() == []
    _, rows = documents(spark, SMALL)
    found = QUERIES["op9_host_quality"](spark, SMALL)
    assert as_set(found.select(names).collect()) == as_set(brute.counts(rows))
    assert found.where("kept and base_failed").count() == 0


def test_failing_hosts_lose_their_documents(spark):
    prepare(spark)
    good = [(k, prose(80), f"host{k % 6}") for k in range(120)]
    bad = [(1000 + k, "short" if k % 5 else prose(80), "bad") for k in range(60)] + [(2000, prose(80), "small"), (2001, "short", "small")]
    rows = {r["doc_id"]: r for r in host_quality(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(rows[k]["kept"] for k in range(120))
    assert not any(rows[1000 + k]["kept"] for k in range(60)) and not rows[1000]["base_failed"]
    assert rows[2000]["kept"]  # half of two documents is too little to go by


# -- URL rules

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/1",
    "http://deep.www.example.com/en/1", "http://notexample.com/en/", "http://example.net/es/", "http://net/fr/x", "http://x.net?es/",
    "http://x.net/e", "http://x.org/en/", "ftp://example.com/a://b/en/", "http://com", "http://.com/", "http://a..com/", "x://y.com/\nz",
]


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    lowered = brute.lowered(host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (lowered == h or lowered.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return url, lowered, path, best[3] if best else None, best[2] if best else default


@pytest.mark.parametrize("extra", [[], [("www.example.com", "/", "block"), ("example.com", "", "allow"), ("com", "/en/", "block"), ("", "/", "block"), ("com", "/", "block")]])
def test_url_rules(spark, extra):
    rules = URL_RULES + extra
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, None), (5, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASHING if c != "url"})
    found = judge_urls(pages, rule_table(spark, rules)).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert as_set(found) == as_set((k, *judged(u, rules)) for k, u in rows)
    assert judge_urls(pages.limit(0), rule_table(spark, rules)).collect() == []
    assert {r["rule"] for r in judge_urls(pages, rule_table(spark, [])).collect()} == {None}


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, rows = documents(spark, SMALL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        assert docs.columns == before.columns, name
        docs = docs.cache()
        assert 0.85 * before.count() <= docs.count() <= before.count()
    mixed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in docs.collect()}
    check_mix(mixed)


def test_pipeline_of_odd_rows(spark, odd, nothing):
    import corpus_pipeline

    for start in (odd, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
            docs.count()


def plain_grid(rows):
    """(row, column, width) of the cells (columns, rows, text) of a table: the first free place of each row."""
    taken, placed = set(), []
    for y, cells in enumerate(rows):
        x = 0
        for span, down, text in cells:
            while (y, x) in taken:
                x += 1
            taken |= {(y + j, x + i) for i in range(span) for j in range(max(down or len(rows) - y, 1))}
            placed.append((y, x, span, text))
            x += span
    return placed


def test_tables_against_a_plain_grid():
    """Random tables with cells over several columns and rows: every cell begins in its column, in its row's line."""
    rng_ = random.Random(11)
    for _ in range(300):
        rows = []
        for y in range(rng_.randint(1, 6)):
            rows.append([
                (rng_.choice([1, 1, 1, 2, 3]), rng_.choice([1, 1, 1, 2, 3, 0]), "".join(rng_.choice("abcdef") for _ in range(rng_.randint(1, 9))) + f"{y}")
                for _ in range(rng_.randint(1, 5))
            ])
        html = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={b}>{t}" for a, b, t in cells) for cells in rows)
        placed = plain_grid(rows)
        widths = collections.Counter()
        for _, x, span, text in placed:
            if span == 1:
                widths[x] = max(widths[x], len(text))
        lines = html_to_text(f"<table>{html}</table>").split("\n")
        assert len(lines) == len(rows)
        for y, x, span, text in placed:
            at = sum(widths[c] + 2 for c in range(x))
            # a cell that is wider than its columns moves those behind it in its row
            moved = any(sum(widths[c] + 2 for c in range(a, a + s)) - 2 < len(t) for b, a, s, t in placed if b == y and a < x)
            assert (moved and text in lines[y]) or lines[y][at : at + len(text)] == text, (rows, lines)


def test_fields_lists_and_visibility():
    page = """<ol reversed><li>a<li>b</ol><ol type=i start=3><li>x<li>y</ol><ol type=A><li>q<li value=28>r<li type=1>s</ol>
      <textarea>l1\nl2</textarea><input type=tel value=123><input type=checkbox value=no><input placeholder=hint>
      <div style='visibility:hidden'>no<p style='visibility: visible'>yes <b>too</b></p>no</div>
      <span style='content-visibility:hidden'>kept</span>
      <table><tfoot><tr><td>foot<td>f2</tfoot><tr><td style='visibility:hidden'>no<td>y<thead><tr><th>head<th>h2</table>"""
    assert html_to_text(page).split("\n") == [
        "2. a", "1. b", "", "iii. x", "iv. y", "", "A. q", "AB. r", "29. s", "", "l1", "l2", "123hint", "", "yes too", "", "kept", "",
        "head  h2", "      y", "foot  f2",
    ]
