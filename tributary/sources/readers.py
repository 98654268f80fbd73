"""Readers and writers. Text files are read as strings and coerced here, so that the rules are ours and not a parser's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normalize_mutation
from ..operators.dated_priors import dated_priors
from ..operators.preprocess import coerced_counts, with_fractions

COUNT_NAMES = ("count", "alt_count", "y", "k", "success", "altcount")
SIZE_NAMES = ("coverage", "n", "size", "total", "denom", "trials")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "site_id", "date", "mutation", "count", "coverage")])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Raw long CSV, coerced and added up by key."""
    return coerced_counts(read_csv_strings(spark, path))


def read_feature_store(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature table (CSV or Parquet by its name) for the priors: coverage of at least 1, counts clipped, fraction computed again."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv_strings(spark, path)
    df = coerced_counts(df).withColumn("coverage", F.greatest("coverage", F.lit(1)))
    return with_fractions(df.withColumn("count", F.least("count", "coverage")))


def read_snv_strict(spark: SparkSession, path: str) -> DataFrame:
    """As the share stage reads it: `site` and `sample` are taken for site_id and sample_id, and a bad date fails instead of being dropped."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv_strings(spark, path)
    for old, new in (("site", "site_id"), ("sample", "sample_id")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    text = F.col("date").cast("string")
    good = F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.raise_error(F.concat(F.lit("bad date: "), F.coalesce(text, F.lit("null")))).cast("date"))
    return df.withColumns({"date": good, "mutation": normalize_mutation(F.col("mutation")), "count": F.col("count").cast("long"), "coverage": F.col("coverage").cast("long")})


def count_and_size(df: DataFrame) -> tuple[str | None, str | None]:
    """Names of the count and size columns by their aliases, in any case; without one, the first numeric column counts."""
    lower = {c.lower(): c for c in df.columns}
    find = lambda names: next((lower[n] for n in names if n in lower), None)
    numeric = next((f.name for f in df.schema if isinstance(f.dataType, T.NumericType)), None)
    return find(COUNT_NAMES) or numeric, find(SIZE_NAMES)


def read_hyperparameters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each mutation; a repeated header line or mutation fails when the rows are read."""
    raw = read_csv_strings(spark, path)
    name = normalize_mutation(F.col("mutation"))
    checked = F.when(name == "MUTATION", F.raise_error(F.lit("repeated header line")).cast("string")).otherwise(name)
    rows = raw.withColumn("mutation", checked).select("mutation", *(F.col(c).try_cast("double").alias(c) for c in raw.columns if c != "mutation"))
    counted = rows.groupBy("mutation").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rows.columns if c != "mutation"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated mutation: "), "mutation")).cast("string")).otherwise(F.col("mutation"))
    return counted.select(once.alias("mutation"), *(c for c in rows.columns if c != "mutation"))


def read_dated_priors(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of dated priors (CSV or Parquet by its name), keyed by date or by site and date."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv_strings(spark, path)
    if missing := {"date", "mutation"} - set(df.columns):
        raise ValueError(f"dated priors need columns {sorted(missing)}")
    day = F.try_to_date(F.substring(F.col("date").cast("string"), 1, 10), "yyyy-MM-dd")
    return dated_priors(df.withColumn("date", day))


def latest(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The newest file that a glob of the candidates finds, candidate after candidate; asks Hadoop's file systems, so any store will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        found = path.getFileSystem(conf).globStatus(path) or []
        if len(found):
            return max(found, key=lambda s: s.getModificationTime()).getPath().toString()
    return None


def write_table(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = True) -> None:
    """Spark's commit protocol makes the write atomic; without overwrite an existing table fails."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    w.option("header", True).option("quoteAll", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def table_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum, for a manifest."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
