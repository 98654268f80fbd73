"""The Spark aggregations of the mixture fit against a plain fit of one mutation at a time."""

from __future__ import annotations

import datetime

import brute_zibb as plain
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.kernels import rw2, zibb
from tributary.operators import mixture
from tributary.plans import models, priors

DAY = datetime.date(2024, 1, 1)


def counts(seed: int, days: int, per_day: int, rate: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for k in range(per_day):
            n = int(rng.integers(5, 300))
            mu = np.clip(rate * (1 + np.sin(d / 4)) + 0.01, 0.01, 0.95)
            y = int(rng.binomial(n, rng.beta(mu * 25, (1 - mu) * 25)) * (rng.random() > 0.15))
            rows.append((f"S{k % 4}", DAY + datetime.timedelta(days=d), f"u{k}", f"M{seed}", y, n))
    return rows


@pytest.fixture(scope="module")
def rows():
    return counts(1, 30, 40, 0.2) + counts(2, 12, 9, 0.05) + counts(3, 4, 5, 0.4) + [("S1", DAY + datetime.timedelta(days=d), "u", "M9", 0, 40) for d in range(3)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "site_id string, date date, sample_id string, mutation string, count long, coverage long")


def of(rows, mutation):
    own = sorted((r for r in rows if r[3] == mutation), key=lambda r: (r[1], r[0], r[2]))
    dates, day = np.unique([r[1] for r in own], return_inverse=True)
    return own, dates, day, np.array([r[4] for r in own], float), np.array([r[5] for r in own], float)


@pytest.mark.parametrize("s", [mixture.Settings(rounds=3, min_rows=60), mixture.Settings(rounds=0, bins=8, min_rows=30), mixture.Settings(rounds=2, calibrate=False)])
def test_fit_equals_the_plain_one(frame, rows, s):
    ready = frame.select("site_id", "sample_id", "date", "mutation", F.col("count").cast("double").alias("y"), F.col("coverage").cast("double").alias("n")).cache()
    f = priors.fitted(ready, s)
    got = {(r.mutation, r.date, r.site_id, r.sample_id): r for r in f.rows.collect()}
    fits = {r.mutation: r for r in f.fits.collect()}
    days = {(r.mutation, r.date): r for r in f.days.collect()}
    assert len(got) == len(rows) and set(fits) == {r[3] for r in rows}
    for m, fit in fits.items():
        own, dates, day, y, n = of(rows, m)
        want = plain.fit(day, len(dates), y, n, s)
        assert np.allclose(fit.edges, want.edges, atol=1e-9)
        mine = [got[m, r[1], r[0], r[2]] for r in own]
        assert np.allclose([r.m for r in mine], want.mu, atol=1e-9) and [r.bin for r in mine] == want.bins.tolist()
        assert np.allclose([r.kappa for r in mine], want.kappa, rtol=1e-6) and np.allclose([r.pi for r in mine], want.pi, atol=1e-8)
        for k, d in enumerate(dates):
            r = days[m, d]
            assert np.allclose([r.mu, r.lo, r.hi, r.var_a], [want.day.mu[k], want.day.lo[k], want.day.hi[k], want.day.var_a[k]], rtol=1e-6, atol=1e-9)


def test_detail_widens_as_the_plain_bisection_does(frame, rows):
    s = mixture.Settings(rounds=1, min_rows=60)
    out = models.prior_detail(frame, s, 3, 1.0)
    assert out.columns == [c.split()[0] for c in priors.DETAIL.split(", ")]
    own, dates, day, y, n = of(rows, "M1")
    f = plain.fit(day, len(dates), y, n, s)
    tau = plain.widening(f, np.minimum(y, n), n, s)
    got = sorted((r for r in out.filter("mutation = 'M1' and kind = 'row'").collect()), key=lambda r: (r.date, r["count"], r.coverage))
    order = sorted(range(len(own)), key=lambda k: (own[k][1], own[k][4], own[k][5]))
    assert np.allclose([r.tau for r in got], tau[f.bins][order], rtol=1e-9)
    kappa = f.kappa / tau[f.bins]
    assert np.allclose([r.kappa_t for r in got], kappa[order], rtol=1e-6)
    lo50, hi50, lo90, hi90 = zibb.intervals(n.astype(int), f.mu, kappa, f.pi, 0.5, 0.9)
    assert [(r.y_lo_50, r.y_hi_50, r.y_lo_90, r.y_hi_90) for r in got] == [tuple(int(x[k]) for x in (lo50, hi50, lo90, hi90)) for k in order]
    series = out.filter("mutation = 'M1' and kind = 'day'").orderBy("date").collect()
    assert [r.date for r in series] == dates.tolist() and np.allclose([r.mu_t for r in series], f.day.mu, atol=1e-9) and {r.site_id for r in series} == {"GLOBAL"}


def test_a_site_named_global_is_a_site(spark, frame):
    named = frame.withColumn("site_id", F.lit("GLOBAL"))
    s = mixture.Settings(rounds=0)
    a, b = (sorted(map(tuple, models.hyperparameters(models.prior_detail(x, s)).collect())) for x in (frame, named))
    assert np.allclose([r[1:] for r in a], [r[1:] for r in b])


def test_few_dates_and_empty_tables(spark, frame):
    assert models.prior_detail(frame.filter("date < '2024-01-03'")).count() == 0
    assert models.prior_detail(frame.limit(0)).count() == 0


def test_isotonic_equals_the_plain_one(spark):
    rng = np.random.default_rng(4)
    rows = [([float(x) for x in rng.integers(0, 9, k)], [float(x) for x in rng.integers(1, 9, k)]) for k in (1, 2, 3, 7, 20) for _ in range(6)]
    df = spark.createDataFrame(rows, "t array<double>, w array<double>")
    for r in df.select("t", "w", mixture.isotonic(F.col("t"), F.col("w")).alias("f")).collect():
        t, w = np.array(r.t), np.array(r.w)
        assert np.allclose(r.f, plain.isotonic(t / w, w))


def test_merged_edges_equal_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    values = {f"m{k}": np.round(rng.beta(0.4, 3, size), 2) for k, size in enumerate((400, 60, 5, 1, 300))} | {"same": np.full(9, 0.2)}
    df = spark.createDataFrame([(m, float(x)) for m, v in values.items() for x in v], "mutation string, m double")
    for bins, least in ((20, 1), (20, 40), (50, 1000), (3, 30)):
        for r in mixture.adaptive_edges(df, bins, least).collect():
            assert np.allclose(r.edges, plain.adaptive_edges(values[r.mutation], bins, least)), (bins, least, r.mutation)


def test_smoother_equals_a_dense_solution():
    """Newton's method with dense matrices, on series of different lengths at a time."""
    rng = np.random.default_rng(6)
    lengths = np.array([1, 2, 3, 4, 9, 40])
    n = rng.integers(3, 200, (40, 6)).astype(float)
    y = rng.binomial(n.astype(int), 0.2).astype(float) + 0.5
    out = rw2.smooth_all(y, n, lengths, 7.0)
    for k, t in enumerate(lengths):
        d = np.diff(np.eye(t), n=2, axis=0) if t > 2 else np.zeros((0, t))
        r = d.T @ d * 7.0 / (1 + n[:t, k].mean() / 5e5)
        a = np.log(out.mu[:t, k] / (1 - out.mu[:t, k]))
        slope = n[:t, k] * out.mu[:t, k] - y[:t, k] + r @ a
        assert np.abs(slope).max() < 1e-7
        h = np.diag(n[:t, k] * out.mu[:t, k] * (1 - out.mu[:t, k]) + rw2.RIDGE) + r
        assert np.allclose(out.var_a[:t, k], np.diag(np.linalg.inv(h)), rtol=1e-8)


def test_bins_of_structural_zeros_alone(spark):
    rows = spark.createDataFrame([("M", 0.0, 50.0, 0.2, 1.0)] * 8 + [("M", 3.0, 50.0, 0.8, 0.0)] * 3, "mutation string, y double, n double, m double, r double")
    fit = spark.createDataFrame([("M", [0.0, 0.5, 1.0])], "mutation string, edges array<double>")
    out = mixture.bin_parameters(rows, fit, mixture.Settings(min_rows=5)).first()
    assert out.kappas == [140.0, 140.0] and out.pis == [pytest.approx(8.5 / 13.5), 0.0]


def test_knots_do_not_depend_on_the_order_of_rows(spark):
    # one rate in a bin: its mean is that rate to the last digit, in whatever order the weights come
    rng = np.random.default_rng(4)
    rates = (0.1, 0.2028125, 0.3)
    rows = [("M", m, float(n), float(round(m * n))) for m in rates for n in rng.integers(1, 5000, 400)]
    df = spark.createDataFrame(rows, "mutation string, m double, n double, y double")
    for parts in (1, 3, 7):
        assert [k.x for k in mixture.calibrator(df.repartition(parts), 50).first().knots] == [0.0, *rates, 1.0]


def test_concentrations_stay_in_the_range_of_their_bins(spark):
    # exp(log(3)) is less than 3
    kappas = F.array(F.lit(3.0), F.lit(3.0), F.lit(140.0))
    edges = F.array(*map(F.lit, (0.0, 0.3, 0.6, 1.0)))
    out = spark.range(101).select(mixture.kappa_at(F.col("id") / 100, edges, kappas).alias("k")).agg(F.min("k"), F.max("k")).first()
    assert out[0] == 3.0 and out[1] <= 140.0


def test_equal_rows_count_as_often_as_they_stand_for(spark):
    one = spark.range(40).select(F.lit("M").alias("mutation"), (F.col("id") / 50 + 0.01).alias("m"), F.lit(50.0).alias("n"), (F.col("id") % 7).cast("double").alias("y"), F.lit(0.1).alias("r"), (F.col("id") % 5 + 1).alias("k"))
    all_ = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k")))).drop("k", "i")
    a, b = (mixture.adaptive_edges(x, 6, 10).first().edges for x in (one, all_))
    assert a == b
    fit = spark.createDataFrame([("M", a)], "mutation string, edges array<double>")
    got, want = (mixture.bin_parameters(x, fit, mixture.Settings(min_rows=5)).first() for x in (one, all_))
    assert np.allclose(got.kappas, want.kappas) and np.allclose(got.pis, want.pis)
