"""The zero-inflated Beta-Binomial fit of every mutation: expectation and maximisation as Spark aggregations.

A round adds up the rows by day (with the weight of not being a structural zero), smooths the daily sums, and adds up the rows by bin of their new rates. Rows
are kept dealt by (mutation, date) and meet two small tables: the days and the fit of each mutation, which are written between rounds. Equal counts of a day are one row with their
number k, so rounds work on different counts, whatever the number of samples. Only the daily sums of a mutation come together, for the smoother; no task holds a mutation's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import digitize
from ..functions.scalars import let
from ..kernels import rw2, zibb
from ..operators import mixture
from ..operators.mixture import Settings
from ..sources.scratch import erased, written

BANDS = ("y_lo_50", "y_hi_50", "p_lo_50", "p_hi_50", "y_lo_90", "y_hi_90", "p_lo_90", "p_hi_90")
#: A fit or the days go to every task if there are at most so many mutations or days (some 2 kB and 100 bytes each).
BROADCAST_FITS, BROADCAST_DAYS = 10_000, 200_000
#: Dates times series that the smoother takes at a time, about.
CELLS = 500_000

_SERIES = "mutation string, days array<struct<date:date,n:double,mu:double,lo:double,hi:double,var_a:double>>"


def smoothed(daily: DataFrame, penalty: float) -> DataFrame:
    """(mutation, date, n, mu, lo, hi, var_a) from daily sums (mutation, date, y, n). A mutation's dates are one row; many go through the smoother together."""
    series = daily.groupBy("mutation").agg(F.array_sort(F.collect_list(F.struct("date", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")))).alias("s"))
    series = series.select("mutation", F.col("s.date").alias("dates"), F.col("s.y").alias("y"), F.col("s.n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["dates"].map(len).to_numpy()
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(order):
                # series of like length together
                ahead = lengths[order[at:]] * np.arange(1, len(order) - at + 1)
                some = order[at : at + max(1, int(np.searchsorted(ahead, CELLS, side="right")))]
                at += len(some)
                n_all = lengths[some]
                y, n = (np.zeros((n_all.max(), len(some))) for _ in range(2))
                for k, row in enumerate(some):
                    y[: n_all[k], k], n[: n_all[k], k] = b["y"].iat[row], b["n"].iat[row]
                s = rw2.smooth_all(y, n, n_all, penalty)
                days = [[{"date": d, "n": n[t, k], "mu": s.mu[t, k], "lo": s.lo[t, k], "hi": s.hi[t, k], "var_a": s.var_a[t, k]} for t, d in enumerate(b["dates"].iat[row])] for k, row in enumerate(some)]
                yield pd.DataFrame({"mutation": b["mutation"].to_numpy()[some], "days": days})

    return series.mapInPandas(run, _SERIES).select("mutation", F.inline("days"))


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


class Fit:
    """Rows (with m, kappa, pi and bin), days (date, mu, lo, hi) and the fit of each mutation."""

    def __init__(self, rows: DataFrame, days: DataFrame, fits: DataFrame) -> None:
        self.rows, self.days, self.fits = rows, days, fits


def fitted(rows: DataFrame, s: Settings) -> Fit:
    """From rows (mutation, date, y, n, ...): the fit after s.rounds rounds. Edges and calibrator are those of the first pass. rows should be kept."""
    rows = rows.withColumn("k", mixture.times(rows))
    daily = rows.groupBy("mutation", "date").agg(F.sum(F.col("y") * F.col("k")).alias("y"), F.sum(F.col("n") * F.col("k")).alias("n"))
    days = written(smoothed(daily, s.penalty), "days")
    n_days = days.count()
    n_fits = days.agg(F.count_distinct("mutation")).first()[0]
    joined = lambda days: rows.join(_small(days, n_days, BROADCAST_DAYS), ["mutation", "date"])
    with_fit = lambda df, fits: df.join(_small(fits, n_fits, BROADCAST_FITS), "mutation")

    first = joined(days.select("mutation", "date", "mu")).withColumn("m", mixture.floored(F.col("mu"), F.col("n"), s))
    knots = mixture.calibrator(first, s.bins) if s.calibrate else rows.select("mutation").distinct().withColumn("knots", F.lit(None).cast("array<struct<x:double,y:double>>"))
    knots = written(knots, "knots")
    rate = lambda mu: mixture.calibrated(mixture.floored(mu, F.col("n"), s), F.col("knots"))
    first = with_fit(first, knots).withColumn("m", rate(F.col("mu")))
    edges = written(knots.join(mixture.adaptive_edges(first, s.bins, s.min_rows), "mutation"), "edges")
    step = mixture.bin_step(s)
    start = F.when(F.col("y") == 0, 0.25).otherwise(0.0)
    # the first concentrations weigh all rows alike, the first inflations count zeros as a quarter
    kappas = step(first.withColumn("r", F.lit(0.0)), edges).select("mutation", "kappas")
    fits = written(edges.join(kappas, "mutation").join(step(first.withColumn("r", start), edges).select("mutation", "pis"), "mutation"), "fits")
    # a plan a round, but its columns are made once
    chance, weight, new_rate = _responsibility(rate(F.col("old"))).alias("r"), F.col("w"), rate(F.col("mu")).alias("m")
    weighed = (F.sum(weight * F.col("y")).alias("y"), F.greatest(F.sum(weight * F.col("n")), F.lit(1.0)).alias("n"))
    for _ in range(s.rounds):
        old = with_fit(joined(days.select("mutation", "date", F.col("mu").alias("old"))), fits).select("mutation", "date", "y", "n", ((1 - chance) * F.col("k")).alias("w"))
        new = smoothed(old.groupBy("mutation", "date").agg(*weighed), s.penalty)
        new_days = written(new.join(days.select("mutation", "date", F.col("mu").alias("old")), ["mutation", "date"]), "days")
        both = with_fit(joined(new_days.select("mutation", "date", "mu", "old")), fits).select("mutation", "y", "n", "k", new_rate, chance)
        new_fits = written(edges.join(step(both, edges), "mutation"), "fits")
        erased(days)
        erased(fits)
        days, fits = new_days, new_fits
    done = with_fit(joined(days.select("mutation", "date", "mu", "lo", "hi")), fits).withColumn("m", rate(F.col("mu")))
    done = done.withColumn("bin", digitize(F.col("m"), F.col("edges"))).withColumns({"kappa": mixture.kappa_at(F.col("m"), F.col("edges"), F.col("kappas")), "pi": F.get("pis", F.col("bin")), "lo": mixture.calibrated(F.col("lo"), F.col("knots")), "hi": mixture.calibrated(F.col("hi"), F.col("knots"))})
    smooth_days = mixture.calibrated_daily(with_fit(days, fits), s).select("mutation", "date", "mu", "lo", "hi", "var_a")
    return Fit(done, smooth_days, fits)


def _responsibility(m: Column) -> Column:
    """Of a row with the fit's columns, at rate m."""

    def chance(m: Column) -> Column:
        pi = F.get("pis", digitize(m, F.col("edges")))
        return mixture.responsibility(F.col("y"), F.col("n"), m, mixture.kappa_at(m, F.col("edges"), F.col("kappas")), pi)

    return F.when(F.col("y") == 0, let(m, chance)).otherwise(0.0)


def _inside(targets: tuple[float, ...]):
    """The chances below and up to a count, as the targets whose central interval holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.clip(b["kappa"].to_numpy() / b["tau"].to_numpy(), 1e-12, 1e12)
            upto, below = zibb.distribution(b["y"].to_numpy(), b["n"].to_numpy(), b["m"].to_numpy(), k, b["pi"].to_numpy())
            hits = {f"in{j}": ((upto >= (1 - t) / 2) & (below < (1 + t) / 2)).astype(float) for j, t in enumerate(targets)}
            yield b[["mutation", "bin", "tau", "k"]].assign(**hits)

    return run


def widening(rows: DataFrame, s: Settings) -> DataFrame:
    """(mutation, bin, tau) of the bins of min_rows or more, from rows (mutation, bin, y, n, m, kappa, pi), y at most n.

    tau, 1 at least, is what concentrations are divided by so that intervals cover their targets: geometric bisection of all open bins at once, a pass over their rows for each halving.
    """
    low = max(1.0, s.tau_bounds[0])
    high = max(low * 1.0001, s.tau_bounds[1])
    hits = ", ".join(f"in{j} double" for j in range(len(s.targets)))
    slim = rows.select("mutation", "bin", F.col("y").cast("long").alias("y"), F.col("n").cast("long").alias("n"), "m", "kappa", "pi", mixture.times(rows).alias("k"))

    def gaps(tried: DataFrame) -> DataFrame:
        """tried (mutation, bin, tau) with gap: how much coverage exceeds its target, least of all targets."""
        each = slim.join(tried, ["mutation", "bin"]).mapInPandas(_inside(s.targets), f"mutation string, bin int, tau double, k long, {hits}")
        least = F.least(F.lit(1.0), *(F.sum(F.col(f"in{j}") * F.col("k")) / F.sum("k") - t for j, t in enumerate(s.targets)))
        return each.groupBy("mutation", "bin", "tau").agg(least.alias("gap"))

    full = slim.groupBy("mutation", "bin").agg(F.sum("k").alias("rows")).filter(F.col("rows") >= s.min_rows)
    ends = gaps(full.select("mutation", "bin", F.explode(F.array(F.lit(low), F.lit(high))).alias("tau")))
    ends = ends.groupBy("mutation", "bin").agg(F.max(F.when(F.col("tau") == low, F.col("gap"))).alias("at_low"), F.max(F.when(F.col("tau") == high, F.col("gap"))).alias("at_high"))
    tau = F.when(F.col("at_low") >= -s.tolerance, low).when(F.col("at_high") <= -s.tolerance, high)
    state = written(ends.select("mutation", "bin", F.lit(low).alias("left"), F.lit(high).alias("right"), tau.alias("tau")), "tau")
    middle = F.sqrt(F.col("left") * F.col("right"))
    for _ in range(s.tau_rounds):
        tried = state.filter("tau is null").select("mutation", "bin", middle.alias("mid"))
        if not tried.head(1):
            break
        got = gaps(tried.select("mutation", "bin", F.col("mid").alias("tau"))).select("mutation", "bin", "gap")
        g = F.col("gap")
        new = state.join(got, ["mutation", "bin"], "left").select("mutation", "bin", F.when(g < 0, middle).otherwise(F.col("left")).alias("left"), F.when(g >= 0, middle).otherwise(F.col("right")).alias("right"), F.when(F.abs(g) <= s.tolerance, middle).otherwise(F.col("tau")).alias("tau"))
        new = written(new, "tau")
        erased(state)
        state = new
    return state.select("mutation", "bin", F.coalesce("tau", middle).alias("tau"))


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = b["coverage"].to_numpy()
        lo50, hi50, lo90, hi90 = zibb.intervals(n, b["mu_t"].to_numpy(), b["kappa_t"].to_numpy(), b["pi"].to_numpy(), 0.5, 0.9)
        out = {}
        for lo, hi, tag in ((lo50, hi50, "50"), (lo90, hi90, "90")):
            out |= {f"y_lo_{tag}": lo, f"y_hi_{tag}": hi, f"p_lo_{tag}": lo / np.maximum(n, 1), f"p_hi_{tag}": hi / np.maximum(n, 1)}
        yield b.assign(**out)


DETAIL = "kind string, site_id string, date date, mutation string, count long, coverage long, af double, mu_t double, mu_lo double, mu_hi double, kappa_t double, pi double, tau double, " + ", ".join(f"{c} {'long' if c[0] == 'y' else 'double'}" for c in BANDS)
_CELLS = "raw_y double, raw_n double, date date, mutation string, count long, coverage long, af double, mu_t double, mu_lo double, mu_hi double, kappa_t double, pi double, tau double"


def detail(ready: DataFrame, s: Settings) -> DataFrame:
    """Row-level posteriors (kind row), and the daily series of each mutation (kind day; counts and intervals null, site GLOBAL), from rows with count and coverage of 1 at least.

    The result is a written table: the fit is done when this returns.
    """
    # dealt by day, so that the passes over the rows need not shuffle them again
    given = ready.select("site_id", "date", "mutation", F.col("count").cast("double").alias("y"), F.greatest(F.col("coverage").cast("double"), F.lit(1.0)).alias("n"))
    keys = ["mutation", "date", "y", "n"]
    rows = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).repartition("mutation", "date").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        f = fitted(rows, s)
        done = written(f.rows.select("date", "mutation", F.col("y").alias("raw_y"), F.least("y", "n").alias("y"), "n", "k", "m", "lo", "hi", "kappa", "pi", "bin"), "fitted")
    finally:
        rows.unpersist()
    low, high = max(1.0, s.tau_bounds[0]), max(1.0, s.tau_bounds[0]) * 1.0001
    tau = widening(done, s)
    by_bin = tau.groupBy("mutation").agg(F.map_from_entries(F.collect_list(F.struct("bin", "tau"))).alias("taus"))
    # concentration of a bin: the mean of its rows'
    means = done.groupBy("mutation", "bin").agg((F.sum(F.col("kappa") * F.col("k")) / F.sum("k")).alias("kappa")).groupBy("mutation").agg(F.map_from_entries(F.collect_list(F.struct("bin", "kappa"))).alias("means"))
    fits = written(f.fits.select("mutation", "edges").join(means, "mutation", "left").join(by_bin, "mutation", "left"), "taus")
    tau_of = lambda b: F.least(F.greatest(F.coalesce(F.element_at("taus", b), F.lit(1.0)), F.lit(low)), F.lit(max(high, s.tau_bounds[1])))
    shown = done.join(fits.select("mutation", "taus"), "mutation").withColumn("tau", tau_of(F.col("bin")))
    kappa = F.least(F.greatest(F.col("kappa") / F.col("tau"), F.lit(1e-12)), F.lit(1e12))
    shown = shown.select("raw_y", F.col("n").alias("raw_n"), "date", "mutation", F.col("y").cast("long").alias("count"), F.col("n").cast("long").alias("coverage"), (F.col("y") / F.col("n")).alias("af"), F.col("m").alias("mu_t"), F.col("lo").alias("mu_lo"), F.col("hi").alias("mu_hi"), kappa.alias("kappa_t"), "pi", "tau")
    bands = written(shown.mapInPandas(_bands, _CELLS + "".join(f", {c} {'long' if c[0] == 'y' else 'double'}" for c in BANDS)), "bands")
    # every row takes what its day and counts have
    own, b = given.alias("own"), bands.alias("b")
    same = (F.col("own.mutation") == F.col("b.mutation")) & (F.col("own.date") == F.col("b.date")) & F.col("own.y").eqNullSafe(F.col("b.raw_y")) & (F.col("own.n") == F.col("b.raw_n"))
    row = own.join(b, same).select("own.site_id", "b.*").withColumn("kind", F.lit("row"))
    day = f.days.join(fits, "mutation").withColumn("bin", digitize(F.col("mu"), F.col("edges")))
    kappas = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda b: F.coalesce(F.element_at("means", b), F.lit(s.kappa_hi)))
    day = day.withColumn("tau", tau_of(F.col("bin"))).select(F.lit("day").alias("kind"), F.lit("GLOBAL").alias("site_id"), "date", "mutation", F.col("mu").alias("mu_t"), F.col("lo").alias("mu_lo"), F.col("hi").alias("mu_hi"), (mixture.kappa_at(F.col("mu"), F.col("edges"), kappas) / F.col("tau")).alias("kappa_t"), "tau")
    names = [c.split()[0] for c in DETAIL.split(", ")]
    return written(row.select(*names).unionByName(day, allowMissingColumns=True).select(*names), "detail")
