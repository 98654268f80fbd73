"""The steps of the zero-inflated Beta-Binomial fit, each an aggregation by mutation and bin or a column of a row.

A fit is a table with one row for each mutation: `knots` (array<struct<x, y>>, null without calibration), `edges`, and for each bin `kappas` and `pis`. Rows
have mutation, y (count) and n (coverage, 1 at least); m is a row's rate, and k, where there is such a column, says how many equal rows it stands for. No step gathers a mutation's rows: they are added up by
(mutation, bin), and quantiles come from counted values (the rates of a mutation are as many as its dates and coverages).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import digitize, interpolate
from ..functions.scalars import clip01, let, lgamma


@dataclass(frozen=True)
class Settings:
    penalty: float = 7.0
    kappa_lo: float = 3.0
    kappa_hi: float = 140.0
    rounds: int = 18
    bins: int = 50
    min_rows: int = 300
    floor_c: float = 7.0
    floor_most: float = 0.05
    winsor: float = 0.02
    targets: tuple[float, ...] = (0.5, 0.9)
    tolerance: float = 0.02
    tau_bounds: tuple[float, float] = (1.0, 24.0)
    tau_rounds: int = 28
    calibrate: bool = True


def times(rows: DataFrame) -> Column:
    """How many equal rows a row stands for."""
    return F.col("k") if "k" in rows.columns else F.lit(1).cast("long")


def _levels(bins: int) -> Column:
    return F.array(*(F.lit(k / bins) for k in range(bins + 1)))


def _even(low: Column, high: Column, bins: int) -> Column:
    return F.array(*(low + (high - low) * (k / bins) for k in range(bins + 1)))


def isotonic(totals: Column, weights: Column) -> Column:
    """The non-decreasing array nearest to totals / weights by weighted squares: at i the largest over j <= i of the smallest over k >= i of the means of j .. k."""
    running = lambda terms: F.aggregate(terms, F.array(F.lit(0.0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
    n = F.size(totals)

    def fitted(s: Column) -> Column:
        mean = lambda j, k: (F.get(s["y"], k + 1) - F.get(s["y"], j)) / F.greatest(F.get(s["w"], k + 1) - F.get(s["w"], j), F.lit(1e-12))
        at = lambda i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: F.array_min(F.transform(F.sequence(i, n - 1), lambda k: mean(j, k)))))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    sums = F.struct(running(totals).alias("y"), running(weights).alias("w"))
    return F.when(n > 0, let(sums, fitted)).otherwise(totals)


def _blocks(fitted: Column) -> Column:
    """array<struct<x, y>> of bins, in the order of x, with one entry for each run of equal y, at the mean of its x; y is that of the last."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (p["y"] - last["y"] <= 1e-15)
        joined = F.struct((last["sx"] + p["x"]).alias("sx"), (last["k"] + 1).alias("k"), p["y"].alias("y"))
        alone = F.struct(p["x"].alias("sx"), F.lit(1).alias("k"), p["y"].alias("y"))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    grown = F.aggregate(fitted, F.array().cast("array<struct<sx:double,k:int,y:double>>"), step)
    return F.transform(grown, lambda b: F.struct((b["sx"] / b["k"]).alias("x"), b["y"].alias("y")))


def calibrator(rows: DataFrame, bins: int) -> DataFrame:
    """(mutation, knots): a monotone map from rates m to observed rates, from x = 0 to 1; knots is null for fewer than 50 rows or 3 populated bins.

    Rows are binned by quantiles of m (by even edges if these have fewer than 3 values), and the bins' pooled rates are made monotone. A bin's x is the mean of m by weight, from
    decimal sums, so that it doesn't depend on the order of the rows.
    """
    k = times(rows)
    counted = rows.groupBy("mutation").agg(F.sum(k).alias("rows"), F.percentile("m", _levels(bins), k).alias("edges"))
    edges = counted.select("mutation", "rows", F.when(F.size(F.array_distinct("edges")) < 3, _even(F.lit(0.0), F.lit(1.0), bins)).otherwise(F.col("edges")).alias("edges"))
    at = rows.join(edges, "mutation").withColumn("bin", digitize(F.col("m"), F.col("edges")))
    weight = (F.col("n") * k).cast("decimal(16,4)")
    each = at.groupBy("mutation", "bin").agg(F.first("rows").alias("rows"), (F.sum(F.col("m").cast("decimal(21,20)") * weight) / F.sum(weight)).cast("double").alias("x"), F.sum(F.col("n") * k).alias("n"), F.sum(F.col("y") * k).alias("y"))
    point = F.struct(F.col("x"), F.col("bin"), F.col("y").alias("total"), F.col("n").alias("w"))
    g = each.groupBy("mutation").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_list(point)).alias("p"))
    fitted = F.zip_with("p", isotonic(F.transform("p", lambda p: p["total"]), F.transform("p", lambda p: p["w"])), lambda p, y: F.struct(p["x"].alias("x"), y.alias("y")))
    inside = F.transform(_blocks(fitted), lambda k: F.struct(F.least(F.greatest(k["x"], F.lit(0.0)), F.lit(1.0)).alias("x"), clip01(k["y"]).alias("y")))

    def padded(k: Column) -> Column:
        apart = F.filter(k, lambda p, i: F.coalesce(F.get(k, i + 1)["x"] - p["x"] >= 1e-12, F.lit(True)))
        knot = lambda x, y: F.array(F.struct(F.lit(x).alias("x"), y.alias("y")))
        none = F.array().cast("array<struct<x:double,y:double>>")

        def ends(a: Column) -> Column:
            low, high = F.element_at(a, 1), F.element_at(a, -1)
            return F.concat(F.when(low["x"] > 0, knot(0.0, low["y"])).otherwise(none), a, F.when(high["x"] < 1, knot(1.0, high["y"])).otherwise(none))

        return let(apart, ends)

    return g.select("mutation", F.when((F.col("rows") >= 50) & (F.size("p") >= 3), let(inside, padded)).alias("knots"))


def calibrated(m: Column, knots: Column) -> Column:
    return clip01(F.when(knots.isNull(), m).otherwise(interpolate(m, knots)))


def calibrated_daily(daily: DataFrame, s: Settings) -> DataFrame:
    """The smoothed days (mu, lo, hi, var_a, n, knots) through the map: variances on the logit scale by the delta method, the band by the map itself."""
    raw = F.greatest("mu", F.least(s.floor_c / F.greatest("n", F.lit(1.0)), F.lit(s.floor_most)))

    def through(x: Column) -> Column:
        before, after = F.filter("knots", lambda k: k["x"] <= x), F.filter("knots", lambda k: k["x"] > x)
        # a rate of 1 lies in the last segment
        a = F.when(F.size(after) > 0, F.element_at(before, -1)).otherwise(F.get("knots", F.size("knots") - 2))
        b = F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.element_at("knots", -1))
        slope = (b["y"] - a["y"]) / F.greatest(b["x"] - a["x"], F.lit(1e-12))
        return let(calibrated(x, F.col("knots")), lambda out: F.struct(out.alias("mu"), (slope * x * (1 - x) / (out * (1 - out))).alias("jac")))

    out = daily.withColumn("_t", F.when(F.col("knots").isNotNull(), let(raw, through)).otherwise(F.struct(clip01(raw).alias("mu"), F.lit(1.0).alias("jac"))))
    return out.withColumns({"mu": F.col("_t.mu"), "var_a": F.col("var_a") * F.col("_t.jac") * F.col("_t.jac"), "lo": calibrated(F.col("lo"), F.col("knots")), "hi": calibrated(F.col("hi"), F.col("knots"))}).drop("_t")


def adaptive_edges(rows: DataFrame, bins: int, least: int) -> DataFrame:
    """(mutation, edges): quantiles of m; the bin with the fewest rows is merged with its smaller neighbour until all have `least`, or two are left.

    Rows are counted once by bin; merging is a fold over these counts.
    """
    quantiles = rows.groupBy("mutation").agg(F.array_distinct(F.percentile("m", _levels(max(2, bins)), times(rows))).alias("cuts"))
    one = F.element_at("cuts", 1)
    cuts = quantiles.select("mutation", F.when(F.size("cuts") == 1, F.array(F.lit(0.0), F.lit(1.0))).when(F.size("cuts") == 2, _even(one, F.element_at("cuts", 2), 2)).otherwise(F.col("cuts")).alias("cuts"))
    counted = rows.join(cuts, "mutation").groupBy("mutation", digitize(F.col("m"), F.col("cuts")).alias("bin")).agg(F.sum(times(rows)).alias("k"))
    found = counted.groupBy("mutation").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("by_bin")).join(cuts, "mutation")
    counts = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda b: F.coalesce(F.element_at("by_bin", b), F.lit(0).cast("long")))

    def merged(s: Column, _: Column) -> Column:
        k = F.array_position(s["counts"], F.array_min(s["counts"])).cast("int")
        before, after = F.get(s["counts"], k - 2), F.get(s["counts"], k)
        # the first of the two bins that become one, from 1
        i = F.when(after.isNull() | (before <= after), k - 1).otherwise(k)

        def joined(i: Column) -> Column:
            rest = F.size(s["counts"]) - i - 1
            both = F.array(F.get(s["counts"], i - 1) + F.get(s["counts"], i))
            new_counts = F.concat(F.slice(s["counts"], 1, i - 1), both, F.slice(s["counts"], i + 2, F.greatest(rest, F.lit(0))))
            return F.struct(F.concat(F.slice(s["cuts"], 1, i), F.slice(s["cuts"], i + 2, F.size(s["cuts"]) - i - 1)).alias("cuts"), new_counts.alias("counts"))

        return F.when((F.size(s["counts"]) > 2) & (F.array_min(s["counts"]) < max(1, least)), let(F.greatest(i, F.lit(1)), joined)).otherwise(s)

    done = F.aggregate(F.sequence(F.lit(1), F.size("cuts")), F.struct(F.col("cuts").alias("cuts"), counts.alias("counts")), merged)
    return found.select("mutation", done["cuts"].alias("edges"))


def kappa_at(m: Column, edges: Column, kappas: Column) -> Column:
    """Concentration between the bins' centres, linear on the logarithm, flat beyond them; rounding takes it out of the range of the bins' by no digit."""
    centres = F.transform(F.sequence(F.lit(0), F.size(kappas) - 1), lambda b: F.struct(((F.get(edges, b) + F.get(edges, b + 1)) / 2).alias("x"), F.log(F.greatest(F.get(kappas, b), F.lit(1e-12))).alias("y")))
    return F.least(F.greatest(F.exp(let(centres, lambda c: interpolate(m, c))), F.array_min(kappas)), F.array_max(kappas))


def responsibility(y: Column, n: Column, m: Column, kappa: Column, pi: Column) -> Column:
    """Chance that a zero is structural: pi against a sampled zero. 0 for other counts."""
    p = clip01(pi)

    def odds(s: Column) -> Column:
        zero = lgamma(s["b"] + n) + lgamma(s["k"]) - lgamma(s["k"] + n) - lgamma(s["b"])
        return 1 / (1 + F.exp(zero - (F.log(p) - F.log1p(-p))))

    return F.when(y == 0, let(F.struct(kappa.alias("k"), ((1 - m) * kappa).alias("b")), odds)).otherwise(0.0)


def bin_step(s: Settings) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What bin_parameters does, with its columns made once for many rounds."""
    place = {"bin": digitize(F.col("m"), F.col("edges")), "p": F.col("y") / F.col("n")}
    k = F.col("k")
    limit = F.percentile("p", F.array(F.lit(s.winsor), F.lit(1 - s.winsor)), k).alias("q")
    entry = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("rows", "q")))).alias("limits")
    low = F.get(F.col("l.q"), 0)
    d = F.when(F.col("l.rows") >= 20, F.least(F.greatest("p", low), F.get(F.col("l.q"), 1))).otherwise(F.col("p")) - low
    moved = {"d": d, "w": (1 - F.col("r")) * k, "v": F.col("m") * (1 - F.col("m"))}
    sums = (
        F.sum(k).alias("rows"), F.sum("w").alias("w"), F.sum(F.col("r") * k).alias("r"), F.sum(F.col("w") * F.col("d")).alias("wd"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("wdd"),
        F.sum(F.col("w") * F.col("v") / F.col("n")).alias("noise"), F.sum(F.col("w") * F.col("v") * (F.col("n") - 1) / F.col("n")).alias("most"),
    )
    # a bin whose rows all are structural zeros has no weight
    w = F.nullif(F.col("w"), F.lit(0.0))
    excess = (F.col("wdd") - F.col("wd") * F.col("wd") / w - F.col("noise")) / w
    told = (F.col("rows") >= 5) & (excess > 1e-12)
    kappa = F.when(told, F.least(F.greatest(F.col("most") / w / F.nullif(excess, F.lit(0.0)) - 1, F.lit(s.kappa_lo)), F.lit(s.kappa_hi))).otherwise(s.kappa_hi)
    pi = F.when(F.col("rows") >= s.min_rows, F.least(F.greatest((F.col("r") + 0.5) / (F.col("rows") + 5.5), F.lit(0.0)), F.lit(0.99))).otherwise(0.0)
    told_by_bin = F.map_from_entries(F.collect_list(F.struct("bin", F.struct(kappa.alias("kappa"), pi.alias("pi"))))).alias("b")
    every = F.sequence(F.lit(0), F.size("edges") - 2)
    kappas = F.transform(every, lambda k: F.coalesce(F.element_at("b", k)["kappa"], F.lit(s.kappa_hi))).alias("kappas")
    pis = F.transform(every, lambda k: F.coalesce(F.element_at("b", k)["pi"], F.lit(0.0))).alias("pis")

    def step(rows: DataFrame, fit: DataFrame) -> DataFrame:
        at = rows.withColumn("k", times(rows)).join(fit.select("mutation", "edges"), "mutation").withColumns(place).drop("edges")
        limits = at.groupBy("mutation", "bin").agg(F.sum("k").alias("rows"), limit).groupBy("mutation").agg(entry)
        clipped = at.join(limits, "mutation").withColumn("l", F.element_at("limits", F.col("bin"))).withColumns(moved)
        by_bin = clipped.groupBy("mutation", "bin").agg(*sums).groupBy("mutation").agg(told_by_bin)
        return fit.select("mutation", "edges").join(by_bin, "mutation", "left").select("mutation", kappas, pis)

    return step


def bin_parameters(rows: DataFrame, fit: DataFrame, s: Settings) -> DataFrame:
    """(mutation, kappas, pis), an entry for each bin of the fit's edges, from rows (mutation, y, n, m, r): r is a row's chance to be a structural zero.

    Concentrations come from moments of the observed rates weighted by 1 - r, clipped at their outer quantiles in bins of 20 rows or more; kappa_hi where rows or
    spread don't tell. Inflation is the mean of r, shrunk; 0 in bins of fewer than min_rows.
    """
    return bin_step(s)(rows, fit)


def floored(mu: Column, n: Column, s: Settings) -> Column:
    """A day's rate as a row's: not less than what its coverage can tell."""
    return F.greatest(mu, F.least(s.floor_c / n, F.lit(s.floor_most)))
