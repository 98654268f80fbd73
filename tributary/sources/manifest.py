"""Tables of a run with their manifest: rows and order-free checksums that are observed while the tables are written, not read again."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import latest

MANIFEST = "run_id string, table string, path string, format string, columns string, rows long, checksum string"


def row_checksum(df: DataFrame):
    """Sum of the rows' hashes: the same for any order and partitioning of them."""
    return F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str | None = None, kind: str = "parquet", mirror: str | None = None) -> DataFrame:
    """Writes each table to folder/name (and to mirror/run_id/name), and their manifest to folder/manifest; returns the manifest.

    Each table is computed once: its numbers come with the write, and the mirror is written from what was written. Existing tables are replaced; a run that fails leaves no new manifest.
    """
    if not tables:
        raise ValueError("a run has a table at least")
    run_id, rows = run_id or uuid.uuid4().hex, []
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        seen, path = Observation(), f"{folder.rstrip('/')}/{name}"
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), row_checksum(df).alias("checksum"))
        _put(watched, path, kind)
        if mirror:
            _put(_got(spark, path, kind, df), f"{mirror.rstrip('/')}/{run_id}/{name}", kind)
        rows.append((run_id, name, path, kind, ",".join(df.columns), seen.get["rows"], seen.get["checksum"]))
    out = spark.createDataFrame(rows, MANIFEST)
    out.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return out


def _put(df: DataFrame, path: str, kind: str) -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).option("quoteAll", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def _got(spark: SparkSession, path: str, kind: str, like: DataFrame) -> DataFrame:
    r = spark.read.schema(like.schema)
    return r.option("header", True).csv(path) if kind == "csv" else r.format(kind).load(path)


def changed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(table, rows, checksum, rows_now, checksum_now) of the Parquet tables that no longer are what the manifest says."""
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    now = None
    for r in manifest.filter("format = 'parquet'").select("table", "path").collect():
        df = spark.read.parquet(r.path)
        one = df.agg(F.lit(r.table).alias("table"), F.count(F.lit(1)).alias("rows_now"), row_checksum(df).alias("checksum_now"))
        now = one if now is None else now.unionByName(one)
    if now is None:
        return manifest.select("table", "rows", "checksum", F.col("rows").alias("rows_now"), F.col("checksum").alias("checksum_now")).limit(0)
    return manifest.join(now, "table").filter((F.col("rows") != F.col("rows_now")) | (F.col("checksum") != F.col("checksum_now"))).select("table", "rows", "checksum", "rows_now", "checksum_now")


def found_input(spark: SparkSession, explicit: str | None, patterns: Sequence[str], configured: Sequence[str] = (), fallback: str | None = None) -> str:
    """The input of a stage: the path that was named, else the newest file of the patterns (one after the other), else of the configured folders, else the fallback.

    A named path that isn't there is an error, and so is an input that nothing names.
    """
    if explicit:
        if found := latest(spark, [explicit]):
            return found
        raise FileNotFoundError(explicit)
    for chain in (patterns, configured, [fallback] if fallback else []):
        if found := latest(spark, list(chain)):
            return found
    raise FileNotFoundError(f"none of {[*patterns, *configured, fallback]}")
