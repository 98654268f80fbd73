"""From raw documents to a training mix, in five stages that each call one operator of tributary.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents, of any name, extra ones too. Empty tables pass as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontam, mixing, neardup, quality, secretscan
from tributary.llm.shared import column, read_table, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labelled ones among docs, doesn't reject.

    Repeated rows have equal scores and stay or go together; null and empty texts have the score of the constant.
    """
    scored = quality.quality_scores(docs, read_table(spark, sf_dir, "labels"), docs.columns)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*map(column, docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id. Of repeated rows one stays; null and empty texts are no duplicates."""
    return neardup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with a benchmark item; null and empty texts stay, repeated rows stay or go together."""
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text. All rows stay; null texts stay null."""
    return secretscan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(column, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes: the columns of documents with size, source_size, target and taken (words, repeats counted).

    Documents without words and those that the mix takes nothing of go. Repeated rows are documents of their own; null is a source.
    """
    return mixing.mix_by_source(docs.withColumn("size", mixing.word_count("text"))).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the classifier and the signatures; tests/llm compares run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
