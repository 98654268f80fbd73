"""Constraints over tables that break many of them, and the manifest of a run against recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..operators import constraints as C
from ..operators import intervals as I
from ..registry import query
from ..sources import manifest as W
from ..sources.scratch import shared_dir


def faulty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw events as counts, with times in their dates, signs, small letters and repeated keys; regions as lineages that lack half of the names."""
    e = A.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    snv = e.select(F.concat(F.lit("U"), F.col("user_id") % 50).alias("sample_id"), (F.col("user_id") % 3).alias("site_id"), F.col("ts").alias("date"), F.when(k % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("mutation"), (k - 2).alias("count"), F.floor(F.col("value") * 2).cast("long").alias("coverage"))
    sig = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("mutation"), F.concat(F.lit("R"), "n_regionkey").alias("lineage"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("double")).alias("weight"))
    sig = sig.unionByName(sig)
    lineages = A.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey") * 2).alias("lineage"), F.col("r_name").alias("label"), F.element_at(F.array(*map(F.lit, (" TRUE", "false", "maybe", "1", "False"))), (F.col("r_regionkey") + 1).cast("int")).alias("is_voc"), F.col("r_regionkey").alias("notes"))
    return {"snv": snv, "signatures": sig, "lineages": lineages}


_FAULTY = """ , s AS (SELECT 'U'||cast(user_id%50 AS varchar) AS sample_id, user_id%3 AS site_id, ts AS date, CASE WHEN k%2=0 THEN upper(event_type) ELSE event_type END AS mutation, k-2 AS count, cast(floor(value*2) AS bigint) AS coverage FROM (SELECT *, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events)),
 g1 AS (SELECT n_name AS mutation, 'R'||cast(n_regionkey AS varchar) AS lineage, CASE WHEN n_regionkey<>2 THEN n_regionkey*1.0 END AS weight FROM nation), g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g1),
 l AS (SELECT 'R'||cast(r_regionkey*2 AS varchar) AS lineage, r_name AS label, [' TRUE','false','maybe','1','False'][cast(r_regionkey+1 AS integer)] AS is_voc, r_regionkey AS notes FROM region)"""


def _sql() -> str:
    kinds = {("snv", "date"): "timestamp_ntz", ("snv", "site_id"): "bigint", ("snv", "sample_id"): "string", ("snv", "mutation"): "string", ("snv", "count"): "bigint", ("snv", "coverage"): "bigint", ("signatures", "mutation"): "string", ("signatures", "lineage"): "string", ("signatures", "weight"): "double", ("lineages", "lineage"): "string", ("lineages", "label"): "string", ("lineages", "notes"): "int"}
    names = {"snv": "s", "signatures": "g", "lineages": "l"}
    numbers = {
        "date_is_normalized_daily": "count(*) FILTER (date<>date_trunc('day',date))", "count_nonnegative": "count(*) FILTER (count<0)", "coverage_nonnegative": "count(*) FILTER (coverage<0)", "count_le_coverage": "count(*) FILTER (count>coverage)",
        "mutation_char_set_ok": "count(*) FILTER (NOT regexp_full_match(mutation,'[A-Z0-9:_\\-]*'))", "weight_equals_1": "count(*) FILTER (weight IS DISTINCT FROM 1)", "is_voc_bool_or_coercible": "count(*) FILTER (lower(trim(is_voc)) NOT IN ('true','false'))",
        "key_unique_after_dedup": "count(*)-(SELECT count(*) FROM (SELECT DISTINCT site_id, date, sample_id, mutation FROM s))", "mutation_lineage_unique": "count(*)-(SELECT count(*) FROM (SELECT DISTINCT mutation, lineage FROM g))", "lineage_is_listed": "count(*) FILTER (lineage NOT IN (SELECT lineage FROM l))",
    }
    words = {"unique": "duplicates", "refers": "unlisted", "truth": "na_after_coercion"}
    rows = []
    for c in C.CHECKS:
        t = names[c.table]
        if c.kind == "column":
            rows.append(f"SELECT '{c.table}', '{c.check}', true, ''")
        elif c.kind in ("text", "number", "day"):
            kind = kinds[c.table, c.argument]
            good = {"text": kind == "string", "number": kind in ("bigint", "double"), "day": kind.startswith("timestamp")}[c.kind]
            rows.append(f"SELECT '{c.table}', '{c.check}', {str(good).lower()}, 'type={kind}'")
        elif c.kind == "filled":
            rows.append(f"SELECT '{c.table}', '{c.check}', count(*)>0, 'rows='||cast(count(*) AS varchar) FROM {t}")
        else:
            n = numbers.get(c.check) or ("count(*) FILTER (false)" if kinds[c.table, c.argument] == "string" else f"count({c.argument})")
            rows.append(f"SELECT '{c.table}', '{c.check}', n=0, '{words.get(c.kind, 'violations')}='||cast(n AS varchar) FROM (SELECT {n} AS n FROM {t})")
    return _FAULTY + ' SELECT * FROM (' + " UNION ALL ".join(rows) + ') r("table", "check", passed, details)'


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validated(faulty(spark, sf_dir))


query("PRE_13_constraints", sql(_sql()))(_types)


def manifest_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of a run: the rows of their manifest, and whether what was written has the same rows and checksums."""
    import uuid

    folder = f"{shared_dir(spark)}/tributary/run-{uuid.uuid4().hex}"
    out = W.write_run({"snv": A.snv(spark, sf_dir), "signatures": A.signatures(spark, sf_dir)}, folder, "run")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    changed = W.changed_tables(spark, folder).select("table", F.lit(True).alias("changed"))
    return out.join(changed, "table", "left").select("table", "columns", "rows", F.coalesce("changed", F.lit(False)).alias("changed"))


query("IO_11_15_manifest", sql(" SELECT 'snv' AS \"table\", count(*) AS rows, false AS changed FROM snv UNION ALL SELECT 'signatures', count(*), false FROM signatures"), longs="rows")(lambda s, d: manifest_of_a_run(s, d).drop("columns"))

# Places of orders among overlapping frames, one for each part: of those that hold a place the one of the largest size, then the first.
_FRAMES = "WITH f AS (SELECT p_partkey*37%29000 AS l, p_partkey*37%29000+p_size*20 AS r, 1000000*(100-p_size)+p_partkey AS k, p_name AS label FROM part), o AS (SELECT o_orderkey, o_custkey*o_orderkey%30000 AS place FROM orders)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("p_partkey") * 37 % 29000
    return A.table(spark, sf_dir, "part").select((1_000_000 * (100 - F.col("p_size")) + F.col("p_partkey")).alias("rank"), left.alias("left"), (left + F.col("p_size") * 20).alias("right"), F.col("p_name").alias("label"))


query("JN_11_interval_index", f"{_FRAMES} SELECT o_orderkey, place, arg_min(label, k) AS label, cast(arg_min(l, k) AS bigint) AS left_end FROM o LEFT JOIN f ON place>=l AND place<r GROUP BY ALL", longs="o_orderkey place left_end")(
    lambda s, d: I.located(A.table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * F.col("o_orderkey") % 30000).alias("place")), "place", frames(s, d)).select("o_orderkey", "place", F.col("holder.label").alias("label"), F.col("holder.left").alias("left_end"))
)
