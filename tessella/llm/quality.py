"""Quality rules at host level: rates of rule failures by domain, shrunk by an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .texts import NOT_BLANK, byte_set, covered, of_document, repeated, slabs, span_hash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = sum(byte_set((ord(c), ord(c))) for c in "#*$%&|<>").astype(bool)
GRAM = 3


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for slab in slabs(batch.column("text")):
            words = slab.words(NOT_BLANK)
            first, grams = words.windows(GRAM)
            twice, _ = repeated(of_document(grams, words.doc[first]))
            in_repeat = covered(first[twice], first[twice] + GRAM, len(words))
            start, end, doc = slab.lines()
            upto = np.concatenate([[0], np.cumsum(slab.inside)])
            full = upto[end] > upto[start]
            start, end, doc = start[full], end[full], doc[full]
            _, earlier = repeated(of_document(span_hash(slab.sums, start, end), doc))
            n = slab.n
            found = (
                words.counts,
                slab.totals(slab.inside & ((slab.data & 0xC0) != 0x80)),
                slab.totals(SYMBOLS[slab.data]),
                np.bincount(doc, minlength=n),
                np.bincount(doc[earlier], minlength=n),
                np.bincount(words.doc[in_repeat], minlength=n),
            )
            own = rest.slice(slab.first, n)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *(pa.array(x.astype(np.int64)) for x in found)], [*own.schema.names, *COUNTS]
            )


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of each whole text (null: empty)."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema]
    return kept.mapInArrow(_counted, ", ".join([*fields, *(f"{c} long" for c in COUNTS)]))


def rules() -> dict[str, Column]:
    """Failures of a document by rule; the first two decide about the document itself."""
    words, c = F.col("n_words"), F.col
    return {
        "short": words < 50,
        "repetitive": 100 * c("n_repeat_words") > 50 * words,
        "symbols": 10 * c("n_symbols") > words,
        "duplicate_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 3 * words) | (c("word_chars") > 12 * words),
    }


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Moments of the hosts' rates: alpha and beta. Hosts that do not differ give a prior of 1,000 documents."""
    rate = F.col(rule) / F.col("n_docs")
    row = hosts.agg(F.sum(rule) / F.sum("n_docs"), F.var_samp(rate), F.avg(1 / F.col("n_docs"))).first()
    mean, spread, noise = (float(x) if x is not None else 0.0 for x in row)
    spread -= mean * (1 - mean) * noise  # what chance alone would give
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else 1000.0
    weight = min(max(weight, 1.0), 1000.0)
    return mean * weight, (1 - mean) * weight


def judge_hosts(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """host, n_docs, failures and shrunk rate of each rule, host_failed: whether a rate is above ``threshold``.

    The shrunk rate is (failures + alpha) / (documents + alpha + beta), so a host of few documents is near the rate of
    all hosts. ``counted`` is the stored result of text_counts with a column host.
    """
    failed = rules()
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(r) for r, c in failed.items()]
    hosts = materialise(counted.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *sums), "hosts")
    for r in failed:
        alpha, beta = beta_prior(hosts, r)
        hosts = hosts.withColumn(f"{r}_rate", (F.col(r) + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))
    return hosts.withColumn("host_failed", F.greatest(*(F.col(f"{r}_rate") for r in failed)) > threshold)


def host_quality(docs: DataFrame, host: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, host_failed, kept for every row of ``docs``.

    Words are runs without blanks, case matters. n_dup_lines: lines with a word that equal an earlier line of the text;
    n_repeat_words: words in windows of three words found twice or more in it. base_failed: fewer than 50 words or more
    than half of them in such windows. kept: not base_failed and the host did not fail. Null and empty texts have no
    words and fail; a null host is a host of its own; repeated rows are judged each; other columns are not looked at; an
    empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    counted = materialise(text_counts(docs.select("doc_id", key.alias("host"), "text"), "doc_id", "host"), "quality")
    own = rules()
    judged = counted.join(judge_hosts(counted, threshold).select("host", "host_failed"), "host")
    return judged.withColumn("base_failed", own["short"] | own["repetitive"]).select(
        "doc_id", *COUNTS, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept")
    )
