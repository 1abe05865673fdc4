"""From raw documents to a mix of sources: language, repeated lines, near copies, benchmark passages, target weights.

Each stage works on all rows that the one before it left, read again from the shared folder. All but the last return the
columns of documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import without_contaminated
from tessella.llm.language import accepted
from tessella.llm.line_dedup import without_repeated_runs
from tessella.llm.mixing import mix_sources
from tessella.llm.ngram_join import one_of_each
from tessella.llm.session import prepare
from tessella.scratch import materialise, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without a letter go, and those whose language the net names with a score below 0.4,
    labelled or not."""
    prepare(spark)
    return accepted(docs.select(*COLUMNS), trust_labels=False)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines of 25 words that an earlier text has; texts of nothing else go. Counts n_chars anew."""
    prepare(spark)
    return without_repeated_runs(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    prepare(spark)
    return one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in 13-word windows of benchmark items."""
    prepare(spark)
    return without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of one and a half times all words takes of each document."""
    prepare(spark)
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The net, and components over any number of links, have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark):  # what the stages leave, up to the end
        for name, stage in STAGES:
            with scope(spark):  # what a stage writes on its way
                docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        return materialise(docs, "pipeline", keep=True)
