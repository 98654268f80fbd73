"""Queries over the model stages. Their results have no SQL; what they must satisfy has, and is what the oracles state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..kernels import particles
from ..operators import evidence as V
from ..registry import query
from . import models as M
from .signature_queries import matrix

_FEW = ", ok AS (SELECT mutation FROM snv GROUP BY 1 HAVING count(DISTINCT date)>=3)"


#: The priors' table of each session and folder: a stage writes it once, and the queries that follow read it.
_DETAILS: dict[tuple[str, str], DataFrame] = {}


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DETAILS:
        _DETAILS[key] = M.prior_detail(A.snv(spark, sf_dir))
    return _DETAILS[key]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv = A.snv(spark, sf_dir)
    priors = snv.groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("mu"), F.lit(20.0).alias("kappa"))
    return M.site_shares(snv, matrix(spark, sf_dir), priors)


def forecasts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Rows of these kinds, or of all kinds."""
    wanted = {"kinds": kinds} if kinds else {}
    return M.site_forecasts(A.snv(spark, sf_dir), matrix(spark, sf_dir), **wanted)


def smoothing_slope(daily: DataFrame) -> DataFrame:
    """Per mutation and date: slope of the smoother's objective at its solution, as a share of the coverage. Only the one minimum has slope 0 at every date."""
    w = Window.partitionBy("mutation").orderBy("date")
    bent = daily.withColumn("a", F.log(F.col("mu") / (1 - F.col("mu")))).withColumn("second", F.lead("a", 2).over(w) - 2 * F.lead("a", 1).over(w) + F.col("a"))
    back = lambda k: F.coalesce(F.lag("second", k).over(w), F.lit(0.0))
    pull = F.coalesce("second", F.lit(0.0)) - 2 * back(1) + back(2)
    weight = F.lit(10.0) / (1 + F.avg("n").over(Window.partitionBy("mutation")) / 5e5)
    return bent.withColumn("slope", (F.col("n") * F.col("mu") - F.col("y") + weight * pull) / (1 + F.col("n")))


query("PRI_01_04_smooth_stationary", sql(_FEW + " SELECT mutation, date, cast(sum(count) AS bigint) AS y, cast(sum(coverage) AS bigint) AS n, 0.0 AS slope, true AS inside FROM snv WHERE mutation IN (SELECT mutation FROM ok) GROUP BY ALL"), "slope", "y n")(
    lambda s, d: smoothing_slope(M.daily_smooth(M.enough_dates(A.snv(s, d)))).select("mutation", "date", "y", "n", "slope", F.col("mu").between(F.col("lo"), F.col("hi")).alias("inside"))
)
query("PRI_14_17_intervals", sql(_FEW + " SELECT mutation, count(*) AS n, 0 AS disordered, 0 AS out_of_range FROM snv WHERE mutation IN (SELECT mutation FROM ok) GROUP BY 1"), longs="n disordered out_of_range")(
    lambda s, d: detail(s, d).filter("kind = 'row'").groupBy("mutation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~((F.col("y_lo_90") <= F.col("y_lo_50")) & (F.col("y_lo_50") <= F.col("y_hi_50")) & (F.col("y_hi_50") <= F.col("y_hi_90")))).alias("disordered"), F.count_if(~(F.col("mu_t").between(0, 1) & F.col("pi").between(0, 0.99) & (F.col("tau") >= 1) & F.col("kappa_t").between(3.0 / 24, 140.0) & (F.col("y_hi_90") <= F.col("coverage")))).alias("out_of_range"))
)
query("PRI_18_hyperparameters", sql(_FEW + " SELECT mutation, 0.0 AS gap FROM ok"), "gap")(lambda s, d: M.hyperparameters(detail(s, d)).select("mutation", (F.col("alpha") + F.col("beta") - F.col("kappa")).alias("gap")))
query("PRI_19_global_series", sql(_FEW + " SELECT mutation, date, count(DISTINCT site_id) AS n_sites, true AS good FROM snv WHERE mutation IN (SELECT mutation FROM ok) GROUP BY ALL"), longs="n_sites")(lambda s, d: M.global_series(detail(s, d), A.snv(s, d)).select("mutation", "date", "n_sites", (F.col("mu_t").between(0, 1) & (F.col("kappa_t") > 0)).alias("good")))
query("PRI_20_population_prior")(lambda s, d: M.population_prior(M.hyperparameters(detail(s, d))))
query("PRI_21_enough_dates", sql(_FEW + " SELECT mutation, count(*) AS n FROM snv WHERE mutation IN (SELECT mutation FROM ok) GROUP BY 1"), longs="n")(lambda s, d: M.enough_dates(A.snv(s, d)).groupBy("mutation").agg(F.count(F.lit(1)).alias("n")))
query("LIK_01_02_resolved_priors", sql(", h AS (SELECT mutation, sum(count)/sum(coverage) AS mu, 5.0+count(*) AS kappa FROM snv GROUP BY 1 HAVING max(af)>0.4), t AS (SELECT DISTINCT mutation FROM signatures) SELECT mutation, least(greatest(coalesce(mu,0.5),1e-9),1-1e-9) AS mu, coalesce(kappa,0) AS kappa FROM t LEFT JOIN h USING (mutation)"), "mu kappa")(lambda s, d: M.resolved_priors(A.snv(s, d).groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("mu"), (F.count(F.lit(1)) + 5.0).alias("kappa"), F.max("af").alias("most")).filter("most > 0.4").withColumns({"alpha": F.col("mu") * F.col("kappa"), "beta": (1 - F.col("mu")) * F.col("kappa")}), A.signatures(s, d)))
_DAYS = ", dy AS (SELECT DISTINCT site_id, date FROM snv WHERE mutation IN (SELECT mutation FROM signatures))"
query("LIK_10_11_simplex", sql(_DAYS + " SELECT site_id, date, 1.0 AS total, true AS nonnegative, 4 AS lineages FROM dy"), "total", "lineages")(lambda s, d: shares(s, d).filter("kind = 'theta'").groupBy("site_id", "date").agg(F.sum("theta").alias("total"), (F.min("theta") >= 0).alias("nonnegative"), F.count(F.lit(1)).alias("lineages")))
query("LIK_12_13_uncertainty", sql(_DAYS + " SELECT site_id, count(*) AS days, true AS sd_ok, true AS leverage_ok FROM dy GROUP BY 1"), longs="days")(lambda s, d: shares(s, d).groupBy("site_id").agg(F.count_distinct(F.when(F.col("kind") == "theta", F.col("date"))).alias("days"), F.bool_and(F.when(F.col("kind") == "theta", F.col("theta_sd") >= 0)).alias("sd_ok"), F.bool_and(F.when(F.col("kind") == "residual", F.col("leverage").between(0, 1))).alias("leverage_ok")))
query("LIK_14_residuals", sql(_DAYS + ", mu AS (SELECT count(DISTINCT mutation) AS m FROM signatures JOIN snv USING (mutation)) SELECT site_id, date, m AS n FROM dy, mu"), longs="n")(lambda s, d: shares(s, d).filter("kind = 'residual' and pred_af between 0 and 1").groupBy("site_id", "date").agg(F.count(F.lit(1)).alias("n")))
query("LIK_15_16_calibrated", sql(_DAYS + " SELECT site_id, date, true AS wider FROM dy"))(lambda s, d: (lambda x: M.calibrated_uncertainty(x.filter("kind = 'theta'").select("site_id", "date", "lineage", "theta_sd"), x.filter("kind = 'residual'")).join(x.filter("kind = 'theta'").select("site_id", "date", "lineage", F.col("theta_sd").alias("old")), ["site_id", "date", "lineage"]).groupBy("site_id", "date").agg(F.bool_and(F.col("theta_sd") >= F.col("old")).alias("wider")))(shares(s, d)))
query("LIK_19_objective_trace")(lambda s, d: shares(s, d).filter("kind = 'trace'").select("site_id", F.col("iter").cast("long").alias("iter"), "objective"))
query("FC_08_11_filtered", sql(_DAYS + " SELECT site_id, date, 1.0 AS total, 1.0 AS smooth_total, true AS ordered FROM dy"), "total smooth_total")(lambda s, d: forecasts(s, d, "filtered").groupBy("site_id", "date").agg(F.sum("mean").alias("total"), F.sum("smooth").alias("smooth_total"), F.bool_and((F.col("q05") <= F.col("median")) & (F.col("median") <= F.col("q95"))).alias("ordered")))
query("FC_06_13_diagnostics", sql(_DAYS + " SELECT site_id, date, true AS ess_ok, true AS pit_ok FROM dy"))(lambda s, d: forecasts(s, d, "ess", "pit").groupBy("site_id", "date").agg(F.bool_and(F.when(F.col("kind") == "ess", F.col("value").between(1, particles.Settings().particles))).alias("ess_ok"), F.coalesce(F.bool_and(F.when(F.col("kind") == "pit", F.col("value").between(0, 1))), F.lit(True)).alias("pit_ok")))
query("FC_12_next_day", sql(_DAYS + " SELECT site_id, max(date)+1 AS date, 1.0 AS total FROM dy GROUP BY 1").replace("max(date)+1 AS date", "cast(max(date)+1 AS date) AS date"), "total")(lambda s, d: forecasts(s, d, "next_share").groupBy("site_id", "date").agg(F.sum("mean").alias("total")))
query("FC_12_next_counts")(lambda s, d: forecasts(s, d, "next_count").select("site_id", "date", "mutation", "mean", "median", "q05", "q95"))
query("FC_14_elpd")(lambda s, d: forecasts(s, d, "elpd").select("site_id", F.col("value").alias("elpd_waic"), (F.col("value") * -2).alias("waic")))
query("FC_16_qq")(lambda s, d: forecasts(s, d, "qq").groupBy("site_id").agg(F.sqrt(F.avg((F.col("value") - F.col("observed")) ** 2)).alias("rmse")))


def predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv = A.snv(spark, sf_dir)
    stats = V.sufficient_statistics(snv).first().asDict()
    whole = snv.groupBy(F.col("count").alias("y"), F.col("coverage").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    seen = snv.groupBy((F.col("count") > 0).cast("long").alias("y"), F.lit(1).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    counts = snv.groupBy(F.col("count").alias("y"), F.lit(0).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    out = None
    for family, prior, a, b in V.MODELS:
        t = M.predictive_tables({"binomial": whole, "bernoulli": seen}.get(family, counts), f"{family}:{prior}", family, stats, a, b)
        out = t if out is None else out.unionByName(t)
    return out
