"""Domain views over the test tables: counts of mutations at sites, and their lineage signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.preprocess import coerced_counts, with_fractions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event; not yet summed by key."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("value") * 10).cast("long").alias("coverage"))
    return e.select(
        F.concat(F.lit("S"), F.col("user_id") % 8).alias("site_id"), F.to_date("ts").alias("date"), F.concat(F.lit("U"), "user_id").alias("sample_id"),
        F.concat_ws(":", F.upper("event_type"), F.col("k") % 8).alias("mutation"), F.least("k", "coverage").alias("count"), "coverage",
    )


def snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fractions(coerced_counts(snv_raw(spark, sf_dir)))


def snv_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape from lineitem, for larger runs; dates are months."""
    li = table(spark, sf_dir, "lineitem").withColumn("coverage", F.floor(F.col("l_extendedprice") / 100).cast("long"))
    raw = li.select(F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("site_id"), F.trunc("l_shipdate", "month").alias("date"), F.col("l_orderkey").cast("string").alias("sample_id"), F.concat("l_returnflag", "l_linestatus", F.lit(":"), F.col("l_partkey") % 8).alias("mutation"), F.least(F.col("l_quantity").cast("long"), "coverage").alias("count"), "coverage")
    return with_fractions(coerced_counts(raw))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mutation, lineage, weight): four lineages over the mutations of snv."""
    e = table(spark, sf_dir, "events").select(F.col("event_type"), (F.get_json_object("props", "$.k").cast("long") % 8).alias("j")).distinct()
    each = e.select(F.concat_ws(":", F.upper("event_type"), "j").alias("mutation"), F.length("event_type").alias("n"), "j", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("l"))
    return each.filter((F.col("n") + F.col("j") * F.col("l") + F.col("l") * F.col("l")) % 5 <= 1).select("mutation", F.concat(F.lit("L"), "l").alias("lineage"), F.lit(1.0).alias("weight"))


#: The same views for DuckDB, as common table expressions.
SNV_SQL = """raw AS (SELECT 'S'||cast(user_id%8 AS varchar) AS site_id, cast(ts AS date) AS date, 'U'||cast(user_id AS varchar) AS sample_id,
 upper(event_type)||':'||cast(k%8 AS varchar) AS mutation, event_type, k%8 AS j, least(k,cov) AS count, cov AS coverage
 FROM (SELECT user_id, ts, event_type, cast(json_extract_string(props,'$.k') AS bigint) AS k, cast(floor(value*10) AS bigint) AS cov FROM events)),
summed AS (SELECT site_id, date, sample_id, mutation, cast(sum(count) AS bigint) AS count, cast(sum(coverage) AS bigint) AS coverage FROM raw GROUP BY ALL),
snv AS (SELECT *, CASE WHEN coverage>0 THEN least(greatest(count/coverage,0),1) ELSE 0.0 END AS af,
 CASE WHEN coverage>0 THEN greatest(0.01, 2.0/coverage) ELSE 0.01 END AS lod_threshold FROM summed),
signatures AS (SELECT mutation, 'L'||cast(l AS varchar) AS lineage, 1.0 AS weight FROM (SELECT DISTINCT upper(event_type)||':'||cast(j AS varchar) AS mutation, length(event_type) AS n, j FROM raw), (SELECT unnest([1,2,3,4]) AS l) WHERE (n+j*l+l*l)%5 <= 1)"""


def sql(body: str) -> str:
    return f"WITH {SNV_SQL} {body}" if not body.lstrip().startswith(",") else f"WITH {SNV_SQL}{body}"
