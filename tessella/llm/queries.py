"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .decontaminate import contamination
from .html_text import extract_text
from .language import identify_languages
from .lattice import score_texts
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import similar_documents
from .oracles import ORACLES
from .planted import missing_letter, repeating_tail
from .quality import COUNTS, host_quality
from .quality_net import classify_quality
from .repeats import repeated_strings
from .session import prepare
from .url_rules import judge_urls, rule_table
from .variants import spelling_variants
from .word_runs import word_runs

#: Host, path and verdict of the URL rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items", "text_key")


def op3_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op9_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    own = [c for c in COUNTS if c != "n_lines"]
    return host_quality(table(spark, folder, "documents")).select("doc_id", *own, "base_failed", "kept")


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_documents(table(spark, folder, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents"))
    return found.withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op6_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_strings(table(spark, folder, "documents")).drop("spans")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).drop("source")


def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), rule_table(spark, URL_RULES)).drop("url")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = word_runs(table(spark, folder, "documents"), rewrite=repeating_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.select("doc_id", "text", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"), F.array_join(lines, "").alias("lines"))
    return found.select(
        "doc_id", "n_runs", (-F.col("run.start")).alias("start"), "run.length", (-F.col("run.period")).alias("period"),
        F.expr("1000 * run.length div -run.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_quality_net(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"), rewrite=missing_letter)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_lattice_score": op3_lattice_score,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_repeated_strings": op6_repeated_strings,
    "op8_html_text": op8_html_text,
    "op9_host_quality": op9_host_quality,
    "op7_source_mix": op7_source_mix,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_net": op12_quality_net,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLES", "QUERIES", "URL_RULES", "table"]
