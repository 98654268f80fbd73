"""Bins: quantile edges, digitising, histograms and piecewise-linear lookup, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.global_order import exact_quantiles
from .scalars import let


def quantile_edges(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., edges): distinct exact quantiles 0, 1 / bins .. 1."""
    if not by:
        return df.sparkSession.createDataFrame([(sorted(set(exact_quantiles(df, value, [k / bins for k in range(bins + 1)])) - {None}),)], "edges array<double>")
    q = F.percentile(value, F.array(*(F.lit(k / bins) for k in range(bins + 1))))
    return df.groupBy(*by).agg(F.array_distinct(q).alias("edges"))


def digitize(x: Column, edges: Column) -> Column:
    """Index of the bin e[i] < x <= e[i + 1]; below the first inner edge 0, above the last inner edge the last bin."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e < x))


def equal_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """0 .. bins - 1 for x in [low, high], the last bin closed; null outside."""
    inside = x.between(low, high)
    return F.when(inside, F.least(F.floor((x - low) * (bins / (high - low))), F.lit(bins - 1)).cast("long"))


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise-linear through knots, array<struct<x, y>> sorted by x, with flat ends."""
    # the knots up to x are counted once; the two around it follow from their number
    at = F.size(F.filter(knots, lambda k: k["x"] <= x))

    def between(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))

    return let(at, lambda k: let(F.struct(F.get(knots, k - 1).alias("a"), F.get(knots, k).alias("b")), between))
