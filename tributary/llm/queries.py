"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, media, mixing, neardup, pii, quality, secretscan, substrings, tandem, urlfilter, variants
from .shared import read_table

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
#: What the html of op7's listed pages holds. Other pages are blocked only if they are one of these under another spelling of its URL.
LISTED_HTML = "$$$"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix_by_source(sized).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = quality.quality_scores(docs, labels, ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    return chat.read_back(chat.formatted(given.unionByName(extra)))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_as_media(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.filter(F.contains("html", F.lit(LISTED_HTML))).select("url")
    return urlfilter.judged(pages, listed, URL_RULES)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.secrets_found(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in secretscan.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("text_key")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def runs_of(docs: DataFrame) -> DataFrame:
    out = tandem.periodic_runs(tandem.with_planted_periods(docs))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = (F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(F.lit(1000) * F.col("length") / F.col("period")).alias("exponent_milli"), *digests)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(read_table(spark, sf_dir, "documents"))


def op12_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.word_counts(read_table(spark, sf_dir, "documents"), least_letters=variants.LEAST_LETTERS, slip_every=199)
    out = variants.spelling_variants(counts.filter(F.col("n") >= variants.LEAST_COUNT))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_quality, op3_pii, op4_near_duplicates, op5_chat, op6_media, op7_url_filter, op8_secrets, op9_decontamination, op10_licenses, op11_periodic_runs, op12_repeated_strings, op13_spelling_variants, pipeline)
}
