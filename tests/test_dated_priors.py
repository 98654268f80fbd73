"""Priors by date: which one holds, what it does to the shares, and runs on priors alone."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.kernels import simplex
from tributary.operators import dated_priors as D
from tributary.plans import models, pipeline
from tributary.sources import readers as R

DAYS = [datetime.date(2024, 1, d) for d in range(1, 6)]
SNV = "site_id string, date date, sample_id string, mutation string, count long, coverage long"
SIG = "mutation string, lineage string, weight double"


@pytest.fixture(scope="module")
def snv(spark):
    return spark.createDataFrame([(s, d, "u", m, c, 20) for s in "AB" for d in DAYS for m, c in (("M1", 10), ("M2", 10))], SNV)


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([("M1", "L1", 1.0), ("M2", "L2", 1.0)], SIG)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("M1", 0.5, 10.0), ("M2", 0.5, 10.0)], "mutation string, mu double, kappa double")


def test_names_stand_in_and_odd_values_are_null(spark):
    rows = [("2024-01-01", " m1 ", "0.2", "5"), ("2024-01-01", "M1", "0.3", "9"), ("2024-01-01", "M2", "nan", "inf"), (None, "M1", "0.1", "1"), ("2024-01-02", "M1", "x", None)]
    df = spark.createDataFrame(rows, "date string, mutation string, mu string, kappa string").withColumn("date", F.try_to_date("date"))
    got = {(str(r.date), r.mutation): (r.mu_t, r.kappa_t) for r in D.dated_priors(df).collect()}
    assert got == {("2024-01-01", "M1"): (0.3, 9.0), ("2024-01-01", "M2"): (None, None), ("2024-01-02", "M1"): (None, None)}
    assert D.dated_priors(df.limit(0)).count() == 0 and "site_id" in D.dated_priors(df.withColumn("site_id", F.lit("A"))).columns


def test_values_hold_for_their_day_or_until_the_next(spark, snv, base):
    dated = D.dated_priors(spark.createDataFrame([("A", DAYS[1], "M1", 0.9, None), ("A", DAYS[3], "M1", None, 7.0), ("A", DAYS[3], "M9", 0.1, 1.0)], "site_id string, date date, mutation string, mu double, kappa double"))

    def resolved(carry):
        return {(r.site_id, r.date.day, r.mutation): (r.mu, r.kappa, r.own) for r in D.resolved_by_date(snv, base, dated, carry).collect()}

    exact, carried = resolved(False), resolved(True)
    assert len(exact) == len(carried) == 20
    assert [exact["A", d, "M1"] for d in range(1, 6)] == [(0.5, 10.0, False), (0.9, 10.0, True), (0.5, 10.0, False), (0.5, 7.0, True), (0.5, 10.0, False)]
    assert [carried["A", d, "M1"] for d in range(1, 6)] == [(0.5, 10.0, False), (0.9, 10.0, True), (0.9, 10.0, True), (0.9, 7.0, True), (0.9, 7.0, True)]
    assert all(v == (0.5, 10.0, False) for k, v in {**exact, **carried}.items() if k[0] == "B" or k[2] == "M2")


def test_shares_change_by_date(spark, snv, matrix, base):
    dated = D.dated_priors(spark.createDataFrame([(d, "M1", 0.02 if d.day < 3 else 0.98, 500.0) for d in DAYS], "date date, mutation string, mu double, kappa double"))
    still = simplex.Settings(temporal=0.0, robust=0)
    by_date = D.resolved_by_date(snv, base, dated)
    out = models.site_shares(snv, matrix, base, still, by_date)
    share = {(r.site_id, r.date.day): r.theta for r in out.filter("kind = 'theta' and lineage = 'L1'").collect()}
    assert all((share[s, d] < 0.3) == (d < 3) and (share[s, d] > 0.7) == (d >= 3) for s in "AB" for d in range(1, 6))
    kappas = {(r.date.day, r.mutation): r.kappa for r in out.filter("kind = 'residual' and site_id = 'A'").collect()}
    assert kappas[1, "M1"] == 500.0 and kappas[1, "M2"] == 10.0
    # no dated value, no change
    plain, same = (sorted((r.site_id, r.date, r.lineage, r.theta) for r in models.site_shares(snv, matrix, base, still, b).filter("kind = 'theta'").collect()) for b in (None, D.resolved_by_date(snv, base, dated.limit(0))))
    assert plain == same


def test_dates_of_priors_alone(spark, snv):
    a = snv.filter("site_id = 'A' and date < '2024-01-03'")
    by_date = D.dated_priors(spark.createDataFrame([(DAYS[4], "M1", 0.5, 1.0)], "date date, mutation string, mu double, kappa double"))
    by_site = by_date.withColumn("site_id", F.lit("C"))
    days = lambda *x, **k: sorted((r.site_id, str(r.date)) for r in D.prior_only_days(*x, **k).collect())
    assert days(a) == [("A", "2024-01-01"), ("A", "2024-01-02")]
    assert days(a, by_date) == [("A", "2024-01-05")]
    assert days(a, by_site) == [("A", "2024-01-01"), ("A", "2024-01-02"), ("C", "2024-01-05")]
    assert days(a, by_site, fill_from_counts=False) == [("A", "1970-01-01"), ("C", "2024-01-05")]
    assert days(a.limit(0)) == [("PRIOR_ONLY", "1970-01-01")] and days(a.limit(0), by_site) == [("C", "2024-01-05")]


def test_shares_of_priors_alone_follow_the_priors(spark, snv, matrix):
    base = spark.createDataFrame([("M1", 0.8, 100.0), ("M2", 0.2, 100.0)], "mutation string, mu double, kappa double")
    out = models.site_shares(snv, matrix, base, simplex.Settings(robust=0), None, D.prior_only_days(snv.filter("site_id = 'A'")))
    theta = {(r.site_id, r.date.day, r.lineage): r.theta for r in out.filter("kind = 'theta'").collect()}
    assert len(theta) == 10 and all(abs(theta["A", d, "L1"] - 0.8) < 0.02 for d in range(1, 6))
    resid = out.filter("kind = 'residual'").collect()
    assert all((r.obs_af, r.coverage) == ((0.8, 100.0) if r.mutation == "M1" else (0.2, 100.0)) for r in resid)


def test_pipeline_takes_dated_priors(spark, snv, matrix, tmp_path):
    path = str(tmp_path / "dated")
    spark.createDataFrame([("2024-01-01", "m1", "0.05", "900"), ("bad", "m1", "0.5", "1")], "date string, mutation string, mu string, kappa string").coalesce(1).write.option("header", True).csv(path)
    dated = R.read_dated_priors(spark, path)
    settings = simplex.Settings(temporal=0.0, robust=0)
    first = lambda **k: np.array(pipeline.run(snv, matrix, ["likelihood"], models.priors.Settings(rounds=0), settings, None, **k)["theta_estimates"].filter("lineage = 'L1' and date = '2024-01-01'").agg(F.max("theta")).first())[0]
    assert first() > 0.4 and first(dated=dated) < 0.3
    with pytest.raises(ValueError):
        R.read_dated_priors(spark, str(write_plain(spark, tmp_path / "plain")))


def write_plain(spark, path):
    spark.createDataFrame([("1",)], "mutation string").write.option("header", True).csv(str(path))
    return path
