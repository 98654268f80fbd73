"""Conjugate baseline models: marginal evidence from one pass of sufficient statistics, ranks, posteriors and Bayes factors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import betaln, lgamma, log_choose

# The models compared: family, prior, and (alpha, beta) or, for gaussian, whose mean and scale come from the data, (kappa0, alpha0).
MODELS: tuple[tuple[str, str, float, float], ...] = (
    ("bernoulli", "jeffreys", 0.5, 0.5),
    ("bernoulli", "uniform", 1.0, 1.0),
    ("bernoulli", "beta22", 2.0, 2.0),
    ("binomial", "jeffreys", 0.5, 0.5),
    ("binomial", "uniform", 1.0, 1.0),
    ("binomial", "beta22", 2.0, 2.0),
    ("poisson", "gamma_1_1_rate", 1.0, 1.0),
    ("poisson", "gamma_2_1_rate", 2.0, 1.0),
    ("poisson", "gamma_3_1_rate", 3.0, 1.0),
    ("gaussian", "weak_auto", 1e-3, 2.0),
    ("gaussian", "mild_auto", 1e-1, 2.0),
)


def model_table(spark: SparkSession) -> DataFrame:
    rows = [(f, p, f"{f}:{p}", a, b) for f, p, a, b in MODELS]
    return spark.createDataFrame(rows, "family string, prior_name string, model_id string, p1 double, p2 double")


def sufficient_statistics(snv: DataFrame) -> DataFrame:
    """One row for all families: everything that any model's evidence needs, in a single aggregation."""
    y, n = F.col("count").cast("double"), F.col("coverage").cast("double")
    x = (F.col("count") > 0).cast("double")
    return snv.select(y.alias("y"), n.alias("n"), x.alias("x"), log_choose(n, y).alias("lc"), lgamma(y + 1).alias("lf")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.sum("y").alias("sy"), F.sum("n").alias("sn"), F.sum("x").alias("sx"), F.sum("lc").alias("slc"), F.sum("lf").alias("slf"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("sse"), F.var_samp("y").alias("var"),
    )


def log_evidence(family: str, p1: Column, p2: Column) -> Column:
    """Of the statistics above; the combinatorial constant of the binomial family is left out (it is the column slc)."""
    rows = F.col("rows")
    if family == "binomial":
        return betaln(p1 + F.col("sy"), p2 + F.col("sn") - F.col("sy")) - betaln(p1, p2)
    if family == "bernoulli":
        return betaln(p1 + F.col("sx"), p2 + rows - F.col("sx")) - betaln(p1, p2)
    if family == "poisson":
        return -F.col("slf") + p1 * F.log(p2) - (p1 + F.col("sy")) * F.log(p2 + rows) + lgamma(p1 + F.col("sy")) - lgamma(p1)
    b0 = F.greatest(F.lit(1e-12), F.col("var") * F.greatest(F.lit(1.0), p2 - 1))
    kn, an, bn = p1 + rows, p2 + rows / 2, b0 + F.col("sse") / 2
    return lgamma(an) - lgamma(p2) + p2 * F.log(b0) - an * F.log(bn) + 0.5 * (F.log(p1) - F.log(kn)) - 0.5 * rows * math.log(math.pi)


def evidence(snv: DataFrame) -> DataFrame:
    """(model_id, family, prior_name, log_evidence): eleven models against one row of statistics."""
    both = model_table(snv.sparkSession).crossJoin(F.broadcast(sufficient_statistics(snv)))
    value = F.lit(None).cast("double")
    for f in ("binomial", "poisson", "gaussian", "bernoulli"):
        value = F.when(F.col("family") == f, log_evidence(f, F.col("p1"), F.col("p2"))).otherwise(value)
    return both.select("model_id", "family", "prior_name", value.alias("log_evidence"))


def posteriors(scores: DataFrame) -> DataFrame:
    """Posterior probabilities and ranks within the family and overall, from log evidences. A model list is small."""
    family, everyone = Window.partitionBy("family"), Window.partitionBy(F.lit(1))

    d = scores.withColumn("d", F.col("log_evidence") - F.max("log_evidence").over(family))
    d = d.withColumn("posterior_prob_family", F.exp("d") / F.sum(F.exp("d")).over(family))
    d = d.withColumn("d", F.col("log_evidence") - F.max("log_evidence").over(everyone))
    d = d.withColumn("posterior_prob_global", F.exp("d") / F.sum(F.exp("d")).over(everyone))
    d = d.withColumns({"family_rank": F.row_number().over(family.orderBy(F.desc("log_evidence"), "model_id")), "global_rank": F.row_number().over(everyone.orderBy(F.desc("log_evidence"), "model_id"))})
    return d.drop("d").withColumns({"best_in_family": F.col("family_rank") == 1, "best_global": F.col("global_rank") == 1})


def bayes_factors(scores: DataFrame) -> DataFrame:
    """Every better model against every worse one, in the family and overall; infinite from e ** 700. A self-join of a short list on rank."""
    r = posteriors(scores)
    cols = ["model_id", "family", "log_evidence", "family_rank", "global_rank"]
    a, b = r.select(*(F.col(c).alias(f"a_{c}") for c in cols)), r.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    log = F.col("a_log_evidence") - F.col("b_log_evidence")

    def out(pairs: DataFrame, scope: str, family: Column) -> DataFrame:
        return pairs.select(F.lit(scope).alias("scope"), family.alias("family"), F.col("a_model_id").alias("better_model"), F.col("b_model_id").alias("worse_model"), log.alias("log_bayes_factor"), F.when(log >= 700, F.lit(float("inf"))).otherwise(F.exp(F.least(log, F.lit(700.0)))).alias("bayes_factor"))

    within = a.join(b, (F.col("a_family") == F.col("b_family")) & (F.col("a_family_rank") < F.col("b_family_rank")))
    overall = a.join(b, F.col("a_global_rank") < F.col("b_global_rank"))
    return out(within, "family", F.col("a_family")).unionByName(out(overall, "global", F.lit("ALL")))
