"""Scores of forecasts as aggregates. Values that are null are left out, as are their weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, normal_cdf, normal_ppf
from .global_order import counted_places, running_sums

EPS = 1e-12


def weighted_mean(x: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))
    w = F.when(x.isNotNull(), w)
    return F.sum(w * x) / (F.sum(w) + EPS)


def rmse(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(weighted_mean((y - p) * (y - p), w))


def mae(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted_mean(F.abs(y - p), w)


def brier(y: Column, p: Column, w: Column | None = None) -> Column:
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return weighted_mean((p - y) * (p - y), w)


def interval_coverage(y: Column, lo: Column, hi: Column, w: Column | None = None) -> Column:
    return weighted_mean(((y >= lo) & (y <= hi)).cast("double"), w)


def divergence(df: DataFrame, keys: Sequence[str], p: str, q: str, base: float = 2.0) -> DataFrame:
    """Kullback-Leibler (p against q) and Jensen-Shannon divergence of each group's renormalised columns."""
    w = Window.partitionBy(*keys)
    n = df.withColumns({"_p": (F.col(p) + EPS) / F.sum(F.col(p) + EPS).over(w), "_q": (F.col(q) + EPS) / F.sum(F.col(q) + EPS).over(w)}).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    log = lambda a, b: F.col(a) * F.log(F.col(a) / F.col(b)) / F.log(F.lit(base))
    return n.groupBy(*keys).agg(F.sum(log("_p", "_q")).alias("kl"), F.sum((log("_p", "_m") + log("_q", "_m")) / 2).alias("js"))


def crps_samples(df: DataFrame, keys: Sequence[str], sample: str, y: str) -> DataFrame:
    """Continuous ranked probability score of each group's samples against its observation, from sorted samples."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"_k": F.row_number().over(w.orderBy(sample)), "_s": F.count(F.lit(1)).over(w)})
    spread = F.sum((2 * F.col("_k") - F.col("_s") - 1) * F.col(sample)) / (F.first("_s") * F.first("_s"))
    return r.groupBy(*keys).agg((F.avg(F.abs(F.col(sample) - F.col(y))) - spread).alias("crps"))


def crps_normal(y: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(EPS))
    return s * let((y - mu) / s, lambda z: z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / 2.5066282746310002 - 1 / 1.7724538509055159)


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """One row for each populated bin: acc, conf, count, mass, contribution to the expected calibration error, edges.

    For quantile bins, ranks by (p, y) come from counted distinct rows, so no task sorts all of them.
    """
    if strategy == "uniform":
        placed = df.select(F.col(y).cast("double").alias("y"), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)).alias("p")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long"))
    elif strategy == "quantile":
        each = df.select(F.col(y).cast("double").alias("y"), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)).alias("p")).groupBy("p", "y").agg(F.count(F.lit(1)).alias("k"))
        n = each.agg(F.sum("k").alias("n"))
        ranked = running_sums(each, ["p", "y"], "k").crossJoin(F.broadcast(n))
        # a bin holds the ranks from lowest on; equal rows take the ranks after upto - k, and may lie in several bins
        lowest = lambda b: F.ceil(b * (F.col("n") + 1) / bins)
        bin_of = lambda rank: F.least(F.floor(rank * bins / (F.col("n") + 1)), F.lit(bins - 1)).cast("long")
        spread = ranked.withColumn("bin", F.explode(F.sequence(bin_of(F.col("upto") - F.col("k") + 1), bin_of(F.col("upto")))))
        last = F.when(F.col("bin") == bins - 1, F.col("n")).otherwise(lowest(F.col("bin") + 1) - 1)
        placed = spread.withColumn("k", F.least("upto", last) - F.greatest(F.col("upto") - F.col("k") + 1, lowest(F.col("bin"))) + 1).filter("k > 0")
    else:
        raise ValueError("strategy must be uniform or quantile")
    rows = F.col("k") if strategy == "quantile" else F.lit(1)
    g = placed.groupBy("bin").agg((F.sum(F.col("y") * rows) / F.sum(rows)).alias("acc"), (F.sum(F.col("p") * rows) / F.sum(rows)).alias("conf"), F.sum(rows).cast("long").alias("count"))
    mass = F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))
    g = g.withColumn("mass", mass)
    return g.withColumns({"contribution": F.col("mass") * F.abs(F.col("acc") - F.col("conf")), "lower": F.col("bin") / bins, "upper": (F.col("bin") + 1) / bins})


def expected_calibration_error(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    return calibration_bins(df, y, p, bins, strategy).agg(F.sum("contribution").alias("ece"))


def weight_diagnostics(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """Effective sample size, its share, entropy (nats and normalised) and degeneracy of each group's weights."""
    n = df.withColumn("_p", F.col(w) / F.sum(w).over(Window.partitionBy(*keys)))
    ess = 1 / F.sum(F.col("_p") * F.col("_p"))
    h = F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0))
    size = F.count(F.lit(1))
    return n.groupBy(*keys).agg(ess.alias("ess"), (ess / size).alias("ness"), h.alias("entropy"), F.when(size > 1, h / F.log(size)).otherwise(0.0).alias("entropy_norm"), (1 - ess / size).alias("degeneracy"))


def log_mean_exp(x: str, by: Window) -> Column:
    top = F.max(x).over(by)
    return top + F.log(F.avg(F.exp(F.col(x) - top)).over(by))


def waic_pointwise(df: DataFrame, obs: str, loglik: str, tau: float = 10.0) -> DataFrame:
    """Per observation: lppd, p_waic, elpd_waic, elpd_loo by importance sampling with weights truncated at tau times their mean."""
    w = Window.partitionBy(obs)
    n = df.withColumn("_top", F.max(loglik).over(w)).withColumn("_low", F.min(loglik).over(w))
    n = n.withColumn("_mean", F.log(F.avg(F.exp(F.col("_low") - F.col(loglik))).over(w)) - F.col("_low"))
    n = n.withColumn("_t", F.least(-F.col(loglik), F.col("_mean") + F.log(F.lit(max(tau, 1.0)))))
    n = n.withColumn("_tt", F.max("_t").over(w))
    g = n.groupBy(obs).agg((F.first("_top") + F.log(F.avg(F.exp(F.col(loglik) - F.col("_top"))))).alias("lppd"), F.var_samp(loglik).alias("p_waic"), (-(F.first("_tt") + F.log(F.avg(F.exp(F.col("_t") - F.col("_tt")))))).alias("elpd_loo"))
    return g.select(obs, "lppd", "p_waic", (F.col("lppd") - F.col("p_waic")).alias("elpd_waic"), "elpd_loo")


def waic_summary(pointwise: DataFrame) -> DataFrame:
    return pointwise.agg((-2 * F.sum("elpd_waic")).alias("waic"), F.sum("elpd_waic").alias("elpd_waic"), F.sum("p_waic").alias("p_waic"), F.sum("lppd").alias("lppd"), F.sum("elpd_loo").alias("elpd_loo"), F.coalesce(F.sqrt(F.count(F.lit(1)) * F.var_samp("elpd_loo")), F.lit(0.0)).alias("elpd_loo_se"))


def waic_delta(pointwise: DataFrame, baseline: DataFrame, obs: str) -> DataFrame:
    """Differences to a baseline model, with standard errors from the pointwise differences."""
    b = baseline.select(obs, F.col("elpd_waic").alias("bw"), F.col("elpd_loo").alias("bl"))
    d = pointwise.join(b, obs).select((F.col("elpd_waic") - F.col("bw")).alias("dw"), (F.col("elpd_loo") - F.col("bl")).alias("dl"))
    n = F.count(F.lit(1))
    return d.agg(F.sum("dw").alias("delta_elpd_waic"), F.coalesce(F.sqrt(n * F.var_samp("dw")), F.lit(0.0)).alias("delta_elpd_waic_se"), F.sum("dl").alias("delta_elpd_loo"), F.coalesce(F.sqrt(n * F.var_samp("dl")), F.lit(0.0)).alias("delta_elpd_loo_se"))


def detection_delay(flags: DataFrame, references: DataFrame) -> DataFrame:
    """Days from the reference date to the first crossing of each site and lineage; null without one."""
    first = flags.filter("threshold_crossed").groupBy("site_id", "lineage").agg(F.min("date").alias("first_date"))
    return references.join(first, ["site_id", "lineage"], "left").withColumn("delay_days", F.datediff("first_date", "ref_date").cast("double"))


def weighted_quantile(df: DataFrame, keys: Sequence[str], x: str, w: str, q: float) -> DataFrame:
    """The first value at which the running weight reaches q of the whole; equal values are added up before they are sorted."""
    g = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(F.greatest(F.coalesce(F.col(w).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_w"))
    if not keys:
        placed = running_sums(g, [x], "_w").crossJoin(F.broadcast(g.agg(F.sum("_w").alias("_all"))))
        return placed.filter(F.col("upto") >= q * (F.col("_all") + EPS)).agg(F.min(x).alias("value")).filter("value is not null")
    p = Window.partitionBy(*keys)
    g = g.withColumns({"_cum": F.sum("_w").over(p.orderBy(x)), "_all": F.sum("_w").over(p)})
    return g.filter(F.col("_cum") >= q * (F.col("_all") + EPS)).groupBy(*keys).agg(F.min(x).alias("value"))


def stratified(df: DataFrame, value: str, strata: Sequence[str], weight: str | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Means overall, by each stratum and by all together in one pass of grouping sets, with unweighted normal intervals.

    Columns: scope (overall, a column's name, or all), the strata (null where they aren't grouped), value, n, ci_lower, ci_upper.
    """
    spark_cols = list(strata)
    sets = [(), *((c,) for c in spark_cols), *([tuple(spark_cols)] if len(spark_cols) > 1 else [])]
    # by name and level, so that a null level isn't taken for a column that isn't grouped
    rows = df.select(*spark_cols, F.col(value).cast("double").alias("_v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    tagged = rows.select(F.explode(F.array(*(F.struct(F.lit("overall" if not s else "all" if len(s) > 1 else s[0]).alias("scope"), *((F.col(c) if c in s else F.lit(None)).cast("string").alias(c) for c in spark_cols)) for s in sets))).alias("g"), "_v", "_w")
    n, sd = F.count(F.lit(1)), F.coalesce(F.stddev_samp("_v"), F.lit(0.0))
    out = tagged.groupBy("g").agg(weighted_mean(F.col("_v"), F.col("_w")).alias("value"), n.alias("n"), (F.avg("_v") - z * sd / F.sqrt(n)).alias("ci_lower"), (F.avg("_v") + z * sd / F.sqrt(n)).alias("ci_upper"))
    return out.select("g.*", "value", "n", "ci_lower", "ci_upper")


def disparity(strata: DataFrame) -> DataFrame:
    """Gap and ratio between the largest and smallest stratum of each scope."""
    return strata.groupBy("scope").agg((F.max("value") - F.min("value")).alias("gap"), (F.max("value") / (F.min("value") + EPS)).alias("ratio"))


def qq_points(df: DataFrame, x: str) -> DataFrame:
    """(i, q_theory, q_emp): normal quantiles at Blom's positions against the sorted sample."""
    placed = counted_places(df, x, "q_emp")
    n = df.agg(F.count(x).alias("n"))
    r = placed.withColumn("i", F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto")))).crossJoin(F.broadcast(n))
    return r.withColumn("p", (F.col("i") - 0.375) / (F.col("n") + 0.25)).select("i", normal_ppf(F.col("p")).alias("q_theory"), "q_emp")
