"""Ranks, quantiles and inversions over whole tables, and tail probabilities."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import tails as T
from tributary.operators import diagnostics as D
from tributary.operators import global_order as G
from tributary.operators import metrics as M


@pytest.fixture(scope="module")
def continuous(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000), rng.lognormal(8, 3, 2000), -rng.lognormal(3, 4, 800), np.repeat(rng.normal(size=5), 200), [1e300, -1e300, 5e-324, 0.0, -0.0]])
    return spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(5)


@pytest.mark.parametrize("few", [10_000, 50, 1])
def test_quantiles_equal_percentile_to_the_last_digit(continuous, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G, "CELLS", 64)
    levels = (0.0, 0.001, 0.01, 0.25, 0.5, 0.77, 0.9, 0.999, 1.0)
    want = continuous.filter("not isnan(v)").agg(F.percentile("v", F.array(*map(F.lit, levels)))).first()[0]
    assert G.exact_quantiles(continuous, "v", levels) == want


def test_quantiles_of_few_and_of_no_values(spark):
    one = spark.createDataFrame([(3,), (None,)], "v long")
    assert G.exact_quantiles(one, "v", (0.0, 0.4, 1.0)) == [3.0, 3.0, 3.0]
    assert G.exact_quantiles(one.limit(0), "v", (0.5,)) == [None]
    assert G.exact_quantiles(spark.range(1, 4), "id", (0.25,)) == [1.5]


def test_running_sums_need_no_task_with_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(k)) for (a, b), k in {(a, b): k for a, b, k in rng.integers(0, 30, (400, 3)).tolist()}.items()]
    df = spark.createDataFrame(rows, "a long, b long, k long")
    out = G.running_sums(df, ["a", "b"], "k")
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    got = {(r.a, r.b): r.upto for r in out.collect()}
    assert got == {(a, b): sum(k for x, y, k in rows if (x, y) <= (a, b)) for a, b, _ in rows}
    assert G.running_sums(df.limit(0), ["a"], "k").count() == 0


def test_places_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.5,), (None,), (2.0,)], "v double")
    assert sorted(map(tuple, G.counted_places(df, "v").collect())) == [(0.5, 1, 1), (1.0, 2, 3), (2.0, 1, 4)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 200])
def test_inversions_equal_all_pairs(n):
    rng = np.random.default_rng(n)
    y, k = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n).astype(float)
    assert G.inversions(y, k) == sum(k[i] * k[j] for i, j in itertools.combinations(range(n), 2) if y[i] > y[j])


@pytest.mark.parametrize("values", [4, 10_000])
def test_kendall_equals_all_pairs(spark, values):
    rng = np.random.default_rng(values)
    x = rng.integers(0, values, 300)
    y = (x + rng.integers(0, values, 300)) % values
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1, None)], "x long, y double").repartition(4)
    pairs = list(itertools.combinations(zip(x.tolist(), y.tolist(), strict=True), 2))
    s = sum(np.sign(b[0] - a[0]) * np.sign(b[1] - a[1]) for a, b in pairs)
    tx, ty = (sum(a[i] == b[i] for a, b in pairs) for i in (0, 1))
    out = D.kendall_tau(df, "x", "y")
    assert out.first()[0] == pytest.approx(s / math.sqrt((len(pairs) - tx) * (len(pairs) - ty)))
    assert "NestedLoop" not in G.running_sums(df.filter("x is not null").groupBy("x").count(), ["x"], "count")._jdf.queryExecution().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_quantile_bins_split_ties_by_rank(spark):
    rng = np.random.default_rng(9)
    p = rng.choice([0.1, 0.2, 0.25, 0.9], 137)
    y = (rng.random(137) < p).astype(float)
    rows = sorted(zip(p.tolist(), y.tolist(), strict=True))
    for bins in (3, 10, 40):
        at = [min(math.floor((r + 1) * bins / 138), bins - 1) for r in range(137)]
        want = {b: (sum(rows[r][1] for r in range(137) if at[r] == b) / at.count(b), sum(rows[r][0] for r in range(137) if at[r] == b) / at.count(b), at.count(b)) for b in set(at)}
        got = {r.bin: (r.acc, r.conf, r["count"]) for r in M.calibration_bins(spark.createDataFrame(rows, "p double, y double"), "y", "p", bins, "quantile").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[b], want[b]) for b in got)


def value(spark, column):
    return spark.range(1).select(column.alias("p")).first()[0]


def test_tails_at_known_points(spark):
    for x, p in ((0.46136, 0.05), (0.34730, 0.10), (0.74346, 0.01), (1.16786, 0.001)):
        assert value(spark, T.cramer_von_mises_tail(F.lit(x))) == pytest.approx(p, rel=2e-3)
    for t, p in ((1.3581, 0.05), (1.6276, 0.01), (0.8276, 0.5), (0.5, 0.9639452436648751)):
        assert value(spark, T.kolmogorov_tail(F.lit(t / 10), F.lit(100))) == pytest.approx(p, rel=1e-3)
    assert value(spark, T.kolmogorov_tail(F.lit(0.0), F.lit(9))) == 1.0
    for x, df, p in ((3.841458820694124, 1, 0.05), (30.14352720564616, 19, 0.05), (2.0, 2, math.exp(-1)), (500.0, 3, 0.0), (0.0, 4, 1.0)):
        assert value(spark, T.chi_square_tail(F.lit(x), F.lit(float(df)))) == pytest.approx(p, abs=1e-12)


def test_normality_of_a_known_sample(spark):
    # moments of 1 .. 100: no skewness, excess kurtosis of a uniform sample
    df = spark.range(1, 101).agg(F.skewness("id").alias("s"), F.kurtosis("id").alias("k"), F.count("id").alias("n"))
    k2, p = T.normality(F.col("s"), F.col("k"), F.col("n"))
    r = df.select(k2.alias("k2"), p.alias("p")).first()
    assert 20 < r.k2 < 60 and r.p == pytest.approx(math.exp(-r.k2 / 2))
    few = spark.range(5).agg(F.skewness("id").alias("s"), F.kurtosis("id").alias("k"), F.count("id").alias("n")).select(T.normality(F.col("s"), F.col("k"), F.col("n"))[0].alias("k2")).first()
    assert few.k2 is None


def test_cramer_von_mises_tail_of_statistics_near_one(spark):
    # the series over Bessel functions, integrated to t = 40
    def exact(x: float) -> float:
        t = np.arange(0, 40, 0.005)
        total = 0.0
        for k in range(12):
            y = (4 * k + 1) ** 2 / (16 * x)
            f = np.exp(-y * (1 + np.cosh(t))) * np.cosh(t / 4)
            total += math.gamma(k + 0.5) / (math.gamma(0.5) * math.factorial(k)) * math.sqrt(4 * k + 1) * 0.005 * (f.sum() - f[0] / 2)
        return 1 - total / (math.pi * math.sqrt(x))

    for x in (0.05, 0.5, 0.96, 0.99, 2.0):
        assert value(spark, T.cramer_von_mises_tail(F.lit(x))) == pytest.approx(exact(x), abs=1e-12)
