"""Lineage shares over sites and dates: composition, smoothing, growth and turnover. All of it is windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.scalars import logit


def top_lineages(theta: DataFrame, k: int = 4, weight: str = "weight") -> DataFrame:
    w = F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1.0))
    g = theta.filter(F.upper("lineage") != "GLOBAL").groupBy("lineage").agg((F.sum(F.col("theta") * w) / F.sum(w)).alias("mean_theta"))
    return g.orderBy(F.desc("mean_theta"), "lineage").limit(k)


def rolled_up(theta: DataFrame, keep: DataFrame, keys: Sequence[str] = ("site_id", "date", "sample_id")) -> DataFrame:
    """The kept lineages, the sum of all others as Other, and shares renormalised within each sample. """
    marked = theta.join(small(keep.select("lineage", F.lit(True).alias("kept"))), "lineage", "left")
    g = marked.groupBy(*keys, F.when(F.col("kept"), F.col("lineage")).otherwise("Other").alias("lineage")).agg(F.sum("theta").alias("theta"))
    return g.withColumn("theta", F.col("theta") / F.greatest(F.sum("theta").over(Window.partitionBy(*keys)), F.lit(1e-12)))


def site_day_shares(theta: DataFrame) -> DataFrame:
    return theta.groupBy("site_id", "date", "lineage").agg((F.sum(F.col("theta") * F.col("weight")) / F.sum("weight")).alias("share"))


def wide_shares(shares: DataFrame, lineages: Sequence[str], min_dates: int = 5) -> DataFrame:
    """One column for each lineage, absent ones 0, for sites with enough dates."""
    wide = shares.groupBy("site_id", "date").pivot("lineage", list(lineages)).agg(F.first("share")).na.fill(0.0)
    return wide.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site_id"))).filter(F.col("n") >= min_dates).drop("n")


def global_shares(shares: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over sites of each date and lineage; weights: site_id, date, weight."""
    return shares.join(weights, ["site_id", "date"]).groupBy("date", "lineage").agg((F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("share"))


def last_composition(shares: DataFrame) -> DataFrame:
    last = F.max("date").over(Window.partitionBy("site_id"))
    return shares.withColumn("last", last).filter("date = last").drop("last")


def rolling_mean(shares: DataFrame, rows: int = 5) -> DataFrame:
    w = Window.partitionBy("site_id", "lineage").orderBy("date").rowsBetween(-(rows // 2), rows // 2)
    return shares.withColumn("smooth", F.avg("share").over(w))


def growth(shares: DataFrame, days: float = 7.0, least: int = 3) -> DataFrame:
    """Slope of the logit share per day, by least squares in a window of so many days around each date; null with fewer points.

    Doubling time of the odds is ln 2 / slope for positive slopes, at most 120.
    """
    d = F.datediff("date", F.lit("1970-01-01"))
    half = int(days // 2)
    w = Window.partitionBy("site_id", "lineage").orderBy("d").rangeBetween(-half, half)
    base = shares.withColumns({"d": d, "y": logit(F.col("share"), 1e-9)})
    slope = F.when(F.count("y").over(w) >= least, F.covar_pop("d", "y").over(w) / F.when(F.var_pop("d").over(w) > 0, F.var_pop("d").over(w)))
    out = base.withColumn("slope", slope)
    return out.select("site_id", "date", "lineage", "slope", F.when(F.col("slope") > 0, F.least(F.log(F.lit(2.0)) / F.col("slope"), F.lit(120.0))).alias("doubling_days"))


def peaks(shares: DataFrame) -> DataFrame:
    """First date of the highest share, by site and lineage."""
    w = Window.partitionBy("site_id", "lineage").orderBy(F.desc("share"), "date")
    return shares.withColumn("r", F.row_number().over(w)).filter("r = 1").select("site_id", "lineage", F.col("date").alias("peak_date"), F.col("share").alias("peak_share"))


def peaks_by_month(shares: DataFrame) -> DataFrame:
    return peaks(shares).groupBy("lineage", F.date_format("peak_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("sites"))


def change_correlation(shares: DataFrame) -> DataFrame:
    """Mean over sites of the correlation of day-to-day changes of each pair of lineages. shares has every lineage on every date of a site."""
    prev = Window.partitionBy("site_id", "lineage").orderBy("date")
    d = shares.withColumn("delta", F.col("share") - F.lag("share").over(prev)).filter("delta is not null")
    a, b = d.select("site_id", "date", F.col("lineage").alias("l1"), F.col("delta").alias("x")), d.select("site_id", "date", F.col("lineage").alias("l2"), F.col("delta").alias("y"))
    each = a.join(b, ["site_id", "date"]).filter("l1 < l2").groupBy("site_id", "l1", "l2").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")).filter("n >= 2")
    return each.groupBy("l1", "l2").agg(F.avg(F.when(~F.isnan("r"), F.col("r"))).alias("mean_r"))


def turnover(theta: DataFrame) -> DataFrame:
    """Shannon entropy (nats) of each date and Jensen-Shannon divergence to the date before; 0 on the first. theta has every lineage on every date."""
    prev = Window.partitionBy("site_id", "lineage").orderBy("date")
    t = theta.withColumn("q", F.lag("theta").over(prev))
    m = (F.col("theta") + F.col("q")) / 2

    def part(p: Column) -> Column:
        return F.when(p > 0, p * F.log(p / m)).otherwise(0.0)

    h = F.sum(F.when(F.col("theta") > 0, -F.col("theta") * F.log("theta")).otherwise(0.0))
    jsd = F.coalesce(F.sum(F.when(F.col("q").isNotNull(), (part(F.col("theta")) + part(F.col("q"))) / 2)), F.lit(0.0))
    return t.groupBy("site_id", "date").agg(h.alias("h"), F.greatest(jsd, F.lit(0.0)).alias("jsd_prev"))


def simplex_projection(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Euclidean projection of each group's vector onto the simplex, by a descending running sum. Groups are solver vectors, so small."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    ranked = df.withColumns({"j": F.row_number().over(w), "cum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    theta = F.max(F.when(F.col(value) * F.col("j") > F.col("cum") - 1, F.struct("j", ((F.col("cum") - 1) / F.col("j")).alias("tau")))).over(Window.partitionBy(*keys))["tau"]
    out = ranked.withColumn("x", F.greatest(F.col(value) - theta, F.lit(0.0)))
    return out.select(*keys, name, (F.col("x") / F.sum("x").over(Window.partitionBy(*keys))).alias("projected"))
