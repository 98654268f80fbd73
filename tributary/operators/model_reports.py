"""Tables that describe fitted models: dispersions, starting shares, detection, bands, approximations and acceptance. All are columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.scalars import betabinom_logpmf, clip01, let, normal_cdf, normal_ppf
from .global_order import counted_places


def zibb_logpmf(y: Column, n: Column, mu: Column, kappa: Column, pi: Column) -> Column:
    """Logarithm of the zero-inflated Beta-Binomial mass: a zero is structural with probability pi. Null where n is 0 or y lies outside 0 .. n."""
    m = clip01(mu)
    return let(betabinom_logpmf(y, n, m * kappa, (1 - m) * kappa), lambda bb: F.when(y == 0, F.log(pi + (1 - pi) * F.exp(bb))).otherwise(F.log(1 - pi) + bb))


def detection_probability(n: Column, mu: Column, kappa: Column, pi: Column, least: int) -> Column:
    """Chance of a count of at least so many, as 1 less the masses below. 0 without coverage."""
    m = clip01(mu)
    below = lambda k: F.when(F.lit(k) <= n, F.exp(betabinom_logpmf(F.lit(float(k)), n, m * kappa, (1 - m) * kappa))).otherwise(0.0)
    total = sum((below(k) for k in range(1, least)), below(0))
    return F.when(n > 0, 1 - pi - (1 - pi) * F.least(total, F.lit(1.0))).otherwise(0.0)


def detection_scores(detail: DataFrame, least: int) -> DataFrame:
    """detail with p_detect and present (whether the count reaches `least`)."""
    n = F.col("coverage").cast("double")
    return detail.withColumns({"p_detect": detection_probability(n, F.col("mu_t"), F.col("kappa_t"), F.col("pi"), least), "present": (F.col("count") >= least).cast("double")})


def detection_summary(scored: DataFrame) -> DataFrame:
    p, x = F.col("p_detect"), F.col("present")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("positive_rate"), F.avg((p - x) * (p - x)).alias("brier"))


def detection_limits(detail: DataFrame, by: str, least: int, power: float = 0.95, low: float = 1e-6, high: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """Per group the smallest rate that is detected with `power` at the group's median coverage, concentration and inflation.

    Bisection of [low, high] until it is narrower than the tolerance; the number of halvings follows from the bounds, so it is one fold of columns.
    """
    g = detail.groupBy(by).agg(F.floor(F.median("coverage")).cast("long").alias("n_star"), F.median("kappa_t").alias("kappa_star"), F.median("pi").alias("pi_star"))
    steps = max(0, math.ceil(math.log2((high - low) / tolerance)))

    def halve(acc: Column, _: Column) -> Column:
        def narrowed(mid: Column) -> Column:
            enough = detection_probability(F.col("n_star").cast("double"), mid, F.col("kappa_star"), F.col("pi_star"), least) >= power
            return F.struct(F.when(enough, acc["lo"]).otherwise(mid).alias("lo"), F.when(enough, mid).otherwise(acc["hi"]).alias("hi"))

        return let((acc["lo"] + acc["hi"]) / 2, narrowed)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), halve)
    return g.withColumn("lod", found["hi"])


def qa_scorecard(coverage: DataFrame, ks: DataFrame, fit: DataFrame, detection: DataFrame) -> DataFrame:
    """(module, metric, value, status). coverage: nominal, bias, miss_low, miss_high. ks: d. fit: mean_z, sd_z, rmsz, variance_ratio. detection: roc_auc."""
    asym, bias = F.abs(F.col("miss_high") - F.col("miss_low")), F.abs("bias")
    tol = F.when(F.col("nominal") >= 0.9, 0.02).otherwise(0.03)
    status = F.when((bias > tol + 0.02) | (asym > tol + 0.02), "FLAG").when((bias <= tol) & (asym <= tol), "PASS").otherwise("MINOR")
    a = coverage.select(F.lit("Coverage").alias("module"), F.format_string("%.2f", F.col("nominal").cast("double")).alias("metric"), F.col("bias").alias("value"), status.alias("status"))
    b = ks.select(F.lit("PIT"), F.lit("KS"), F.col("d"), F.when(F.col("d") <= 0.03, "PASS").when(F.col("d") <= 0.05, "MINOR").otherwise("FLAG"))
    good = sum(x.cast("int") for x in (F.abs("mean_z") <= 0.05, F.col("sd_z").between(0.95, 1.05), F.col("rmsz").between(0.95, 1.05), F.col("variance_ratio").between(0.9, 1.1)))
    c = fit.select(F.lit("Fit"), F.lit("z/VR"), good.cast("double"), F.when(good == 4, "PASS").when(good == 3, "MINOR").otherwise("FLAG"))
    d = detection.filter("roc_auc is not null").select(F.lit("Detection"), F.lit("ROC-AUC"), F.col("roc_auc"), F.when(F.col("roc_auc") >= 0.85, "PASS").when(F.col("roc_auc") >= 0.75, "MINOR").otherwise("FLAG"))
    return a.union(b).union(c).union(d)


def dispersions(priors: DataFrame, mutations: DataFrame, default: float = 200.0) -> DataFrame:
    """(mutation, phi) of every wanted mutation: column phi, else alpha + beta, else the default; the priors' median where it has none; 1 at least."""
    own = F.col("phi").cast("double") if "phi" in priors.columns else F.col("alpha") + F.col("beta") if {"alpha", "beta"} <= set(priors.columns) else F.lit(default)
    given = priors.select("mutation", own.alias("phi"))
    middle = given.agg(F.median("phi").alias("middle"))
    each = given.groupBy("mutation").agg(F.max("phi").alias("phi"))
    wanted = mutations.select("mutation").distinct().join(each, "mutation", "left").crossJoin(F.broadcast(middle))  # one row
    return wanted.select("mutation", F.greatest(F.coalesce("phi", "middle", F.lit(default)), F.lit(1.0)).alias("phi"))


def prior_counts(priors: DataFrame, days: DataFrame) -> DataFrame:
    """Prior-only mode: each prior (mutation, mu, kappa) as kappa * mu counts out of kappa, on every (site_id, date) of days. As many priors as the model has mutations."""
    return days.select("site_id", "date").distinct().crossJoin(small(priors.select("mutation", "mu", "kappa"))).select("site_id", "date", F.concat("site_id", F.lit("__date")).alias("sample_id"), "mutation", (F.col("kappa") * F.col("mu")).alias("count"), F.col("kappa").alias("coverage"))


def residual_report(residuals: DataFrame) -> DataFrame:
    """One row: samples, sites, mean absolute and root mean square residual."""
    r = F.col("obs_af") - F.col("pred_af")
    return residuals.agg(F.count_distinct("site_id", "date").alias("samples"), F.count_distinct("site_id").alias("sites"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"))


def observed_and_predicted(snv: DataFrame, theta: DataFrame, matrix: DataFrame) -> DataFrame:
    """(site_id, date, mutation, obs_af, pred_af) of every date with shares and every mutation of the matrix; obs_af is null without coverage."""
    pred = theta.select("site_id", "date", "lineage", "theta").join(matrix, "lineage").groupBy("site_id", "date", "mutation").agg(clip_unit(F.sum(F.col("theta") * F.col("weight"))).alias("pred_af"))
    obs = snv.groupBy("site_id", "date", "mutation").agg(F.sum("count").alias("y"), F.sum("coverage").alias("n"))
    return pred.join(obs, ["site_id", "date", "mutation"], "left").select("site_id", "date", "mutation", F.when(F.col("n") > 0, clip_unit(F.col("y") / F.col("n"))).alias("obs_af"), "pred_af")


def clip_unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def most_varying(matrix: DataFrame, value: str, k: int) -> DataFrame:
    """Per site the k mutations whose value varies most over dates, nulls left out; ties by name."""
    v = matrix.groupBy("site_id", "mutation").agg(F.var_pop(value).alias("variance"))
    w = Window.partitionBy("site_id").orderBy(F.round("variance", 12).desc_nulls_last(), "mutation")
    return v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def acceptance(forecast: DataFrame, particles: int) -> DataFrame:
    """One row from the tagged rows of the forecasts: normalised effective sizes, transforms, widely applicable criterion and count errors."""
    kind = lambda k, x: F.when(F.col("kind") == k, x)
    ness = F.col("value") / particles
    rmse = forecast.filter("kind = 'qq'").groupBy("site_id").agg(F.sqrt(F.avg((F.col("value") - F.col("observed")) ** 2)).alias("rmse")).agg(F.avg("rmse").alias("rmse_counts_mean"))
    return forecast.agg(
        F.median(kind("ess", ness)).alias("median_ness"), F.avg(kind("ess", (ness < 0.2).cast("double"))).alias("frac_ness_low"), F.avg(kind("pit", F.col("value"))).alias("pit_mean"), F.var_samp(kind("pit", F.col("value"))).alias("pit_var"),
        F.avg(kind("elpd", F.col("value"))).alias("mean_elpd_waic"), F.avg(kind("elpd", -2 * F.col("value"))).alias("mean_waic"),
    ).crossJoin(rmse)  # one row each


def share_bands(theta: DataFrame, z: float = 1.96) -> DataFrame:
    """Shares with lo and hi at the site with the most dates (of equals, the first name); a missing sd is the lineage's median at that site."""
    best = theta.groupBy("site_id").agg(F.count_distinct("date").alias("days")).orderBy(F.desc("days"), "site_id").limit(1).select("site_id")
    day = theta.join(F.broadcast(best), "site_id").groupBy("site_id", "date", "lineage").agg(F.avg("theta").alias("theta"), F.avg("theta_sd").alias("sd"))
    usual = day.groupBy("lineage").agg(F.median("sd").alias("usual"))
    out = day.join(usual, "lineage").withColumn("sd", F.coalesce("sd", "usual"))
    return out.select("site_id", "date", "lineage", "theta", clip_unit(F.col("theta") - z * F.col("sd")).alias("lo"), clip_unit(F.col("theta") + z * F.col("sd")).alias("hi"))


def median_objective(trace: DataFrame) -> DataFrame:
    return trace.groupBy("iter").agg(F.median("objective").alias("objective"), F.count(F.lit(1)).alias("sites"))


def logistic_qq(df: DataFrame, value: str) -> DataFrame:
    """(value, from_rank, to_rank, q): distinct values with the places they hold among all rows, and the normal quantile of their middle place by the logistic approximation."""
    placed = counted_places(df, value).withColumnRenamed("upto", "to_rank").crossJoin(F.broadcast(df.agg(F.count(value).alias("n"))))
    p = ((F.col("to_rank") - (F.col("k") - 1) / 2) - 0.5) / F.col("n")
    return placed.select("value", (F.col("to_rank") - F.col("k") + 1).alias("from_rank"), "to_rank", (F.log(p / (1 - p)) / 1.702).alias("q"))


def bb_moments(n: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Mean and variance of a Beta-Binomial count."""
    return n * a / (a + b), n * a * b * (a + b + n) / ((a + b) * (a + b) * (a + b + 1))


def bb_cdf_normal(y: Column, n: Column, a: Column, b: Column) -> Column:
    """Normal approximation of the distribution function, with half a count of continuity correction, for counts too large for a table."""
    mean, var = bb_moments(n, a, b)
    return clip01(normal_cdf((y + 0.5 - mean) / F.sqrt(F.greatest(var, F.lit(1e-18)))))


def bb_ppf_normal(q: float, n: Column, a: Column, b: Column) -> Column:
    """Normal approximation of the quantile: moved half a count away from the mean, rounded to even and held in 0 .. n."""
    mean, var = bb_moments(n, a, b)
    off = normal_ppf(F.lit(q)) * F.sqrt(F.greatest(var, F.lit(1e-18)))
    return F.least(F.greatest(F.bround(mean + off + F.signum(off) * 0.5), F.lit(0.0)), n).cast("long")
