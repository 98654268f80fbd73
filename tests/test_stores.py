"""Constraints, manifests and the choice of inputs."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tributary.operators import constraints as C
from tributary.sources import manifest as W

SNV = "sample_id string, site_id string, date date, mutation string, count long, coverage long"


def snv(spark, *rows):
    return spark.createDataFrame([(s, "A", datetime.date(2024, 1, 1), m, c, n) for s, m, c, n in rows], SNV)


def test_checks_of_the_stages_are_all_there():
    count = {t: sum(c.table == t and c.kind != "refers" for c in C.CHECKS) for t in ("snv", "signatures", "lineages")}
    assert count == {"snv": 22, "signatures": 11, "lineages": 12} and len({(c.table, c.check) for c in C.CHECKS}) == len(C.CHECKS)


def test_good_tables_pass_and_faults_are_counted(spark):
    sig = spark.createDataFrame([("M1", "L1", 1.0), ("M2", None, 1.0)], "mutation string, lineage string, weight double")
    lin = spark.createDataFrame([("L1", "one", True, None)], "lineage string, label string, is_voc boolean, notes string")
    good = {"snv": snv(spark, ("s", "M1", 1, 2), (None, "M1", 0, 0), ("s", None, 0, 5)), "signatures": sig, "lineages": lin}
    out = C.validated(good).collect()
    assert len(out) == 46 and all(r.passed for r in out)
    bad = {"snv": snv(spark, ("s", "m 1", 3, 2), ("s", "m 1", -1, 2)), "signatures": sig.withColumn("lineage", F.lit("L7")), "lineages": lin.withColumn("is_voc", F.lit("perhaps"))}
    failed = {(r.table, r.check): r.details for r in C.validated(bad).collect() if not r.passed}
    assert failed == {("snv", "count_nonnegative"): "violations=1", ("snv", "count_le_coverage"): "violations=1", ("snv", "mutation_char_set_ok"): "violations=2", ("snv", "key_unique_after_dedup"): "duplicates=1", ("signatures", "lineage_is_listed"): "unlisted=2", ("lineages", "is_voc_bool_or_coercible"): "na_after_coercion=1"}


def test_missing_columns_and_tables(spark):
    out = C.validated({"snv": snv(spark, ("s", "M1", 1, 2)).drop("coverage"), "signatures": spark.createDataFrame([], "mutation string, lineage string, weight double")}).collect()
    own = [r for r in out if r.table == "snv"]
    assert [r.check for r in own if not r.passed] == ["has_column:coverage"] and len(own) == 6
    assert [(r.check, r.details) for r in out if r.table == "signatures" and not r.passed] == [("non_empty_table", "rows=0")]
    assert not any(r.check == "lineage_is_listed" for r in out)


def test_lineages_are_kept_as_truth_values(spark):
    df = spark.createDataFrame([(" True",), ("FALSE",), ("1",), (None,)], "is_voc string")
    assert [r.is_voc for r in C.lineage_store(df).collect()] == [True, False, None, None]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_manifest_is_what_was_written(spark, tmp_path, kind):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            computed.add(len(b))
            yield b

    a = spark.range(40).select("id", F.concat(F.lit("x,\""), "id").alias("t")).repartition(3).mapInPandas(counted, "id long, t string").withColumnRenamed("t", "a.b")
    out = {r.table: r for r in W.write_run({"a": a, "none": a.limit(0)}, str(tmp_path / "out"), "r1", kind, str(tmp_path / "mirror")).collect()}
    assert (out["a"].rows, out["none"].rows, out["a"].columns) == (40, 0, "id,a.b") and out["none"].checksum == "0"
    assert computed.value == 40 or kind == "csv" or computed.value >= 40
    if kind == "parquet":
        assert W.changed_tables(spark, str(tmp_path / "out")).count() == 0
        again = spark.read.parquet(str(tmp_path / "mirror" / "r1" / "a"))
        assert again.agg(W.row_checksum(again)).first()[0] == out["a"].checksum
        spark.range(39).select("id", F.lit("y").alias("a.b")).write.mode("overwrite").parquet(str(tmp_path / "out" / "a"))
        assert [(r.table, r.rows, r.rows_now) for r in W.changed_tables(spark, str(tmp_path / "out")).collect()] == [("a", 40, 39)]
    with pytest.raises(ValueError):
        W.write_run({}, str(tmp_path / "out"))


def test_inputs_fall_back_in_order(spark, tmp_path):
    for k, name in enumerate(("old.csv", "new.csv", "raw.csv")):
        (tmp_path / name).write_text("x")
        import os

        os.utime(tmp_path / name, (1_000_000 + k, 1_000_000 + k))
    at = lambda x: str(tmp_path / x)
    name = lambda *a, **k: W.found_input(spark, *a, **k).rsplit("/", 1)[1]
    assert name(at("old.csv"), [at("new.csv")]) == "old.csv"
    assert name(None, [at("none*.csv"), at("[on]*.csv")]) == "new.csv"
    assert name(None, [at("none*.csv")], [at("o*.csv")], at("raw.csv")) == "old.csv"
    assert name(None, [at("none*.csv")], [], at("raw.csv")) == "raw.csv"
    for bad in (lambda: W.found_input(spark, at("gone.csv"), []), lambda: W.found_input(spark, None, [at("none*")])):
        with pytest.raises(FileNotFoundError):
            bad()
