"""Calibration diagnostics of fitted rows: moments, coverage tables, transforms, curves and a scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.scalars import normal_ppf
from ..functions.tails import chi_square_tail, cramer_von_mises_tail, kolmogorov_tail, normality
from .global_order import counted_places, discordant, exact_quantiles
from .model_reports import zibb_logpmf
from .preprocess import seeded_digest, wilson


def zibb_moments(mu: Column, kappa: Column, pi: Column, n: Column) -> tuple[Column, Column]:
    """Mean and variance of a zero-inflated Beta-Binomial count."""
    bb_mean, bb_var = n * mu, n * mu * (1 - mu) * (kappa + n) / (kappa + 1)
    return (1 - pi) * bb_mean, (1 - pi) * (bb_var + pi * bb_mean * bb_mean)


def standardised(detail: DataFrame) -> DataFrame:
    m, v = zibb_moments(F.col("mu_t"), F.col("kappa_t"), F.col("pi"), F.col("coverage").cast("double"))
    return detail.withColumns({"mean_y": m, "var_y": v}).withColumn("z", (F.col("count") - F.col("mean_y")) / F.sqrt(F.greatest("var_y", F.lit(1e-12))))


def fit_summary(z: DataFrame) -> DataFrame:
    """Errors, spread and shape of standardised residuals, and the line of observed on expected counts."""
    e = F.col("count") - F.col("mean_y")
    return z.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"), F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rmsz"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("kurtosis"),
        (F.avg(e * e) / F.avg("var_y")).alias("variance_ratio"), F.regr_slope("count", "mean_y").alias("slope"), F.regr_intercept("count", "mean_y").alias("intercept"), F.regr_r2("count", "mean_y").alias("r2"),
    )


def coverage_table(df: DataFrame, y: str, bands: dict[float, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Per nominal level: empirical coverage with Wilson's interval, bias, misses below and above, mean width. All levels in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("nominal"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi")) for t, (lo, hi) in bands.items())))
    rows = df.select(*by, F.col(y).cast("double").alias("y"), each.alias("b")).select(*by, "y", "b.*")
    g = rows.groupBy(*by, "nominal").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").between(F.col("lo"), F.col("hi"))).alias("hits"), F.avg((F.col("y") < F.col("lo")).cast("double")).alias("miss_low"), F.avg((F.col("y") > F.col("hi")).cast("double")).alias("miss_high"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    g = g.withColumn("w", wilson(F.col("hits"), F.col("n")))
    return g.select(*by, "nominal", "n", F.col("w.p").alias("empirical"), F.col("w.lo").alias("ci_lo"), F.col("w.hi").alias("ci_hi"), (F.col("w.p") - F.col("nominal")).alias("bias"), "miss_low", "miss_high", "width")


def quantile_bin(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """df with the right-closed quantile bin of a column; equal edges are one, and the smallest value belongs to the first bin."""
    edges = sorted(set(exact_quantiles(df, value, [k / bins for k in range(bins + 1)])) - {None})
    return df.withColumn(name, F.size(F.filter(F.array(*map(F.lit, edges[1:-1])).cast("array<double>"), lambda e: e < F.col(value))).cast("long"))


def uniform_of(*keys: str, seed: int = 7) -> Column:
    """A uniform number in (0, 1) of a row's key: the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def ks_distance(df: DataFrame, u: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Distance of a sample in [0, 1] from the uniform distribution, from counted values."""
    if by:
        w = Window.partitionBy(*by)
        g = df.filter(F.col(u).isNotNull()).groupBy(*by, u).agg(F.count(F.lit(1)).alias("k"))
        g = g.withColumns({"cum": F.sum("k").over(w.orderBy(u)), "n": F.sum("k").over(w)})
    else:
        g = counted_places(df, u, u).withColumnRenamed("upto", "cum").crossJoin(F.broadcast(df.agg(F.count(u).alias("n"))))
    d = F.max(F.greatest(F.col("cum") / F.col("n") - F.col(u), F.col(u) - (F.col("cum") - F.col("k")) / F.col("n")))
    return g.groupBy(*by).agg(F.max("n").alias("n"), d.alias("d")).filter(F.col("n") >= least)


def transform_statistics(df: DataFrame, u: str, bins: int = 20) -> DataFrame:
    """Chi-square over equal bins and the Cramer-von Mises statistic of a sample in [0, 1]. Ranks of equal values are averaged."""
    n = F.count(F.lit(1))
    h = df.groupBy(F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).alias("b")).agg(n.alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq")).select("n", (F.col("sq") * bins / F.col("n") - F.col("n")).alias("chi2"))
    g = counted_places(df, u, u).withColumnRenamed("upto", "cum").crossJoin(F.broadcast(h.select("n")))
    mid = (F.col("cum") - (F.col("k") - 1) / 2 - 0.5) / F.col("n")
    c = g.agg((F.sum(F.col("k") * ((F.col(u) - mid) ** 2 + (F.col("k") * F.col("k") - 1) / (12 * F.col("n") * F.col("n")))) + 1 / (12 * F.first("n"))).alias("cvm"))
    return h.crossJoin(c)


def variable_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Count, moments and quantiles of each column, one row a column, in one pass."""
    q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    stats = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), F.percentile(c, F.array(*map(F.lit, q))).alias("q")) for c in names]
    out = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return out.select(*(c for c in out.columns if c != "q"), *(F.get("q", k).alias(f"q{int(100 * x):02d}") for k, x in enumerate(q)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 60) -> DataFrame:
    x = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    return df.groupBy(F.least(F.floor((x - low) * (bins / (high - low))), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b from the distinct pairs and how often each occurs; discordant ones are counted by merging sorted ranges. Rows with a null are left out."""
    c = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    c = c.filter("x is not null and y is not null")
    ties = lambda by, t: c.groupBy(*by).agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias(t))
    n = c.agg((F.sum("k") * (F.sum("k") - 1) / 2).alias("n0"))
    # of the pairs that tie in neither, those that aren't discordant are concordant
    s = F.col("n0") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.lit(discordant(c))
    return n.crossJoin(ties(["x"], "tx")).crossJoin(ties(["y"], "ty")).crossJoin(ties(["x", "y"], "txy")).select((s / F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))).alias("tau_b"))


def threshold_curve(df: DataFrame, y: str, p: str, points: int = 401) -> DataFrame:
    """(threshold, tpr, fpr, precision, recall) at even thresholds from high to low: scores are counted by threshold, then added up."""
    at = F.floor(F.col(p) * (points - 1)).cast("long")
    g = df.groupBy(at.alias("i")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i")).join(g, "i", "left").na.fill(0)
    w, everyone = Window.orderBy(F.desc("i")), Window.partitionBy(F.lit(1))
    t = grid.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "all_pos": F.sum("pos").over(everyone), "all_neg": F.sum("neg").over(everyone)})
    return t.select("i", (F.col("i") / (points - 1)).alias("threshold"), (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("fp") / F.col("all_neg")).alias("fpr"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0).alias("precision"))


def curve_areas(curve: DataFrame) -> DataFrame:
    """Areas under the receiver curve and under precision over recall, and the mean of precision over even steps (as the reference states it)."""
    w = Window.orderBy(F.desc("i"))
    t = curve.withColumns({"px": F.coalesce(F.lag("fpr").over(w), F.lit(0.0)), "py": F.coalesce(F.lag("tpr").over(w), F.lit(0.0)), "pp": F.coalesce(F.lag("precision").over(w), F.lit(1.0))})
    return t.agg(F.sum((F.col("fpr") - F.col("px")) * (F.col("tpr") + F.col("py")) / 2).alias("roc_auc"), F.sum((F.col("tpr") - F.col("py")) * (F.col("precision") + F.col("pp")) / 2).alias("pr_auc"), F.avg("precision").alias("mean_precision"))


def proportional_sample(df: DataFrame, stratum: str, key: Sequence[str], n: int, seed: int = 11) -> DataFrame:
    """About n rows, from each stratum by its share: those with the smallest seeded digests."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_own")).crossJoin(F.broadcast(total)).withColumn("_take", F.round(F.col("_own") / F.col("_all") * n)).select(stratum, "_take")
    w = Window.partitionBy(stratum).orderBy(seeded_digest(key, seed), *key)
    return df.join(small(sizes), stratum).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def scorecard(checks: DataFrame) -> DataFrame:
    """(check, value, verdict) from (check, value, pass_at, minor_at): by the distance of the value from 0, smaller is better."""
    v = F.abs("value")
    return checks.select("check", "value", F.when(v <= F.col("pass_at"), "PASS").when(v <= F.col("minor_at"), "MINOR").otherwise("FLAG").alias("verdict"))


def uniformity_tests(df: DataFrame, u: str, bins: int = 20) -> DataFrame:
    """One row: chi-square over equal bins, Cramer-von Mises and Kolmogorov statistics of a sample in [0, 1], each with the chance of a larger one."""
    both = transform_statistics(df, u, bins).crossJoin(F.broadcast(ks_distance(df, u).select("d")))
    return both.select("n", "chi2", chi_square_tail(F.col("chi2"), F.lit(bins - 1.0)).alias("chi2_p"), "cvm", cramer_von_mises_tail(F.col("cvm")).alias("cvm_p"), F.col("d").alias("ks"), kolmogorov_tail(F.col("d"), F.col("n")).alias("ks_p"))


def fit_tests(z: DataFrame) -> DataFrame:
    """One row of standardised residuals (z, with mu_t, kappa_t, pi): mean logarithm of the mass of the counts, and the normality test by skewness and kurtosis."""
    n, y, size = F.count(F.lit(1)), F.col("count").cast("double"), F.col("coverage").cast("double")
    g = z.agg(n.alias("n"), F.avg(zibb_logpmf(y, size, F.col("mu_t"), F.col("kappa_t"), F.col("pi"))).alias("mean_log_mass"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("kurtosis"))
    k2, p = normality(F.col("skew"), F.col("kurtosis"), F.col("n"))
    return g.select("n", "mean_log_mass", k2.alias("k2"), p.alias("k2_p"))


#: Nominal coverages of the calibration grid.
GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def normal_bands(z: DataFrame, levels: Sequence[float] = GRID) -> tuple[DataFrame, dict[float, tuple[str, str]]]:
    """z with the bounds of the normal approximation's central intervals, and their names by level, for coverage_table."""
    names = {t: (f"lo_{round(100 * t)}", f"hi_{round(100 * t)}") for t in levels}
    half = {t: normal_ppf(F.lit((1 + t) / 2)) * F.sqrt("var_y") for t in levels}
    return z.withColumns({n: F.col("mean_y") + s * half[t] for t, ns in names.items() for n, s in zip(ns, (-1, 1), strict=True)}), names
