"""Priors that hold from a date on, or on a date alone: resolved for each site, date and mutation of the share solver, and the dates of a run without counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_mutation

#: Where neither dated priors nor counts tell a site's dates.
NO_DATE = "1970-01-01"


def dated_priors(table: DataFrame) -> DataFrame:
    """([site_id,] date, mutation, mu_t, kappa_t) of a table of dated priors; mu and kappa stand in for missing columns mu_t and kappa_t.

    Rows without a date go. Values that aren't finite are null. Of rows with one key the one of largest kappa_t counts (ties: largest mu_t).
    """
    names = set(table.columns)
    keys = [c for c in ("site_id", "date", "mutation") if c in names]
    value = lambda c, other: F.col(c if c in names else other).try_cast("double") if {c, other} & names else F.lit(None).cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    rows = table.select(*(c for c in keys if c == "site_id"), F.to_date("date").alias("date"), normalize_mutation(F.col("mutation")).alias("mutation"), finite(value("mu_t", "mu")).alias("mu_t"), finite(value("kappa_t", "kappa")).alias("kappa_t"))
    best = F.max(F.struct(F.col("kappa_t"), F.col("mu_t"))).alias("best")
    return rows.filter(F.col("date").isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.mu_t", "best.kappa_t")


def _carried(wanted: DataFrame, dated: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, date) with the last mu_t and kappa_t of that date or before. A window over a key's dates, so the work is linear in them."""
    w = Window.partitionBy(*keys).orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None).cast("double")
    both = dated.select(*keys, "date", F.lit(0).alias("asks"), "mu_t", "kappa_t").unionByName(wanted.select(*keys, "date", F.lit(1).alias("asks"), none.alias("mu_t"), none.alias("kappa_t")))
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("mu_t", "kappa_t")}).filter("asks = 1").drop("asks")


def resolved_by_date(days: DataFrame, base: DataFrame, dated: DataFrame, carry: bool = False) -> DataFrame:
    """(site_id, date, mutation, mu, kappa, own) for each distinct day (site_id, date) and row of base (mutation, mu, kappa; as many as the model has mutations).

    A dated value of the same date (of the site, where dated has sites) takes the place of the base's, rate and concentration each for itself; with carry the last one of
    that date or before does. own tells whether one did. dated is as dated_priors gives it.
    """
    grid = days.select("site_id", "date").distinct().crossJoin(F.broadcast(base.select("mutation", "mu", "kappa")))
    keys = [c for c in ("site_id", "mutation") if c in dated.columns]
    if carry:
        # dates that several sites share are asked for once, where the priors have no sites
        dated = _carried(grid.select(*keys, "date").distinct(), dated, keys)
    found = grid.join(dated, [*keys, "date"], "left")
    # greatest and least pass over nulls
    mu = F.when(F.col("mu_t").isNotNull(), F.least(F.greatest("mu_t", F.lit(1e-9)), F.lit(1 - 1e-9))).otherwise(F.col("mu"))
    kappa = F.when(F.col("kappa_t").isNotNull(), F.greatest("kappa_t", F.lit(0.0))).otherwise(F.col("kappa"))
    return found.select("site_id", "date", "mutation", mu.alias("mu"), kappa.alias("kappa"), (F.col("mu_t").isNotNull() | F.col("kappa_t").isNotNull()).alias("own"))


def prior_only_days(counts: DataFrame, dated: DataFrame | None = None, fill_from_counts: bool = True) -> DataFrame:
    """(site_id, date) of a run on priors alone: a site's dates are those of its dated priors, else those of its counts, else 1970-01-01.

    Sites are those of the counts, and those of the dated priors where these have sites; without any, the one site PRIOR_ONLY.
    """
    sites = counts.select("site_id").distinct()
    if dated is None:
        known = counts.select("site_id", "date").limit(0)
    elif "site_id" in dated.columns:
        known = dated.select("site_id", "date").distinct()
        sites = sites.unionByName(known.select("site_id")).distinct()
    else:
        known = sites.crossJoin(dated.select("date").distinct())
    none = counts.sparkSession.range(1).select(F.lit("PRIOR_ONLY").alias("site_id"))
    sites = sites.unionByName(none.join(sites.agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0).select("site_id"))
    if fill_from_counts:
        known = known.unionByName(counts.select("site_id", "date").distinct().join(known.select("site_id").distinct(), "site_id", "left_anti"))
    rest = sites.join(known.select("site_id").distinct(), "site_id", "left_anti").withColumn("date", F.lit(NO_DATE).cast("date"))
    return known.unionByName(rest)
