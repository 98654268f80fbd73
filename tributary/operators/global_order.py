"""Ranks, quantiles and inversions over a whole table without a task that holds it: ranges, their totals, and what is local to a range."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import erased, written

#: Cells that a range of values is cut into in one pass of a quantile search, and distinct values that are counted one by one.
CELLS = 4_096
FEW = 10_000


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def running_sums(df: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """df with `upto`: the sum of weight over all rows up to a row's place in the order, with all that are equal to it; and `part`, its range.

    The rows are written in ranges of the order, so that each range has one total; a row's sum is that of the ranges before and of its own range up to it. Only the
    ranges' totals, a number for each, come to the driver.
    """
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(_parts(df), *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = sorted((r.part, r.total) for r in ranged.groupBy("part").agg(F.sum(weight).alias("total")).collect())
    zero, before, rows = (0.0 if dict(ranged.dtypes)[weight] in ("double", "float") else 0), None, []
    for part, total in totals:
        before = zero if before is None else before
        rows.append((part, before))
        before = before + (total or zero)
    kind = "double" if isinstance(zero, float) else "long"
    offsets = spark.createDataFrame(rows, f"part int, before {kind}")
    w = Window.partitionBy("part").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "part").withColumn("upto", F.col("before") + F.sum(weight).over(w)).drop("before")


def counted_places(df: DataFrame, value: str, name: str = "value") -> DataFrame:
    """(name, k, upto) of the distinct values that aren't null: how many rows have it, and how many have it or a smaller one."""
    each = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias(name)).agg(F.count(F.lit(1)).alias("k"))
    return running_sums(each, [name], "k").drop("part")


def exact_quantiles(df: DataFrame, value: str, levels: Sequence[float]) -> list[float | None]:
    """Quantiles of the values that aren't null or NaN, linear between neighbours, as `percentile` gives them; None for no values.

    Each wanted rank has a bracket of values. A pass counts the rows of all brackets by cell and keeps, of the cell that holds the rank, its smallest and largest value as the next
    bracket; a bracket of few rows is counted by value instead. What comes to the driver is at most CELLS rows, or FEW values, for each bracket.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(levels)
    places = [x * (n - 1) for x in levels]
    wanted = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    # rank: (smallest, largest value, rows below, rows inside)
    brackets = dict.fromkeys(wanted, (low, high, 0, n))
    found: dict[int, float] = {}
    while brackets:
        found |= {r: b[0] for r, b in brackets.items() if b[0] == b[1]}
        brackets = {r: b for r, b in brackets.items() if r not in found}
        if not brackets:
            break
        several = sorted(set(brackets.values()))
        which = F.coalesce(*(F.when(F.col("v").between(lo, hi), F.lit(i)) for i, (lo, hi, _, _) in enumerate(several)))

        def cell(bracket: tuple) -> Column:
            lo, hi, _, inside = bracket
            # halves, so that the width of no range overflows
            return F.col("v") if inside <= FEW else F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS), F.lit(CELLS - 1)).cast("double")

        at = F.coalesce(*(F.when(F.col("b") == i, cell(b)) for i, b in enumerate(several)))
        counts = rows.withColumn("b", which).filter("b is not null").withColumn("cell", at).groupBy("b", "cell").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        cells: dict[int, list] = {}
        for r in sorted(map(tuple, counts.collect()), key=lambda r: (r[0], r[3])):
            cells.setdefault(r[0], []).append(r[2:])
        for rank, bracket in brackets.items():
            below = bracket[2]
            for k, lo, hi in cells[several.index(bracket)]:
                if rank < below + k:
                    brackets[rank] = (lo, hi, below, k)
                    break
                below += k
    out = []
    for p in places:
        lo, hi = math.floor(p), math.ceil(p)
        a, b = found[lo], found[hi]
        out.append(a if lo == hi or a == b else (hi - p) * a + (p - lo) * b)
    return out


def inversions(y: np.ndarray, k: np.ndarray) -> float:
    """Sum of k[i] * k[j] over i < j with y[i] > y[j], by merging blocks of doubled length."""
    total, place, width = 0.0, np.arange(len(y)), 1
    while width < len(y):
        block = place // (2 * width)
        left = place // width % 2 == 0
        by = np.lexsort((y, block))
        b, v = block[by], y[by]
        sums = np.cumsum(np.where(left, k, 0.0)[by])
        # up to the last of equal values, and up to the end of the block
        last = np.append((b[1:] != b[:-1]) | (v[1:] != v[:-1]), True)
        upto = sums[np.flatnonzero(last)[np.cumsum(last) - last]]
        ends = np.append(b[1:] != b[:-1], True)
        all_left = sums[np.flatnonzero(ends)[np.cumsum(ends) - ends]]
        total += float(np.sum(np.where(left[by], 0.0, k[by] * (all_left - upto))))
        width *= 2
    return total


def _inversions_within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    b = pd.concat(list(batches) or [pd.DataFrame({"part": [], "x": [], "y": [], "k": []})])
    for _, own in b.groupby("part"):
        own = own.sort_values(["x", "y"])
        yield pd.DataFrame({"s": [inversions(own["y"].to_numpy(), own["k"].to_numpy(float))]})


def discordant(pairs: DataFrame) -> float:
    """Sum of k * k' over pairs of rows (x, y, k; pairs (x, y) distinct) with x < x' and y > y'.

    Rows are written in ranges by (x, y). Inversions inside a range are counted in its task. Those between ranges follow from merging: neighbouring ranges, then pairs of
    ranges, and so on, are sorted by y together, and a row of the right half is behind all left ones of larger y. There are log2(ranges) such levels.
    """
    parts = _parts(pairs)
    ranged = written(pairs.select("x", "y", F.col("k").cast("double").alias("k")).repartitionByRange(parts, "x", "y").withColumn("part", F.spark_partition_id()), "ranges")
    total = ranged.repartition(parts, "part").mapInPandas(_inversions_within, "s double").agg(F.sum("s")).first()[0] or 0.0
    width = 1
    while width < parts:
        side = ranged.select(F.floor(F.col("part") / (2 * width)).cast("int").alias("g"), "y", F.when(F.floor(F.col("part") / width) % 2 == 0, F.col("k")).otherwise(0.0).alias("left"), F.when(F.floor(F.col("part") / width) % 2 == 1, F.col("k")).otherwise(0.0).alias("right"))
        side = side.groupBy("g", "y").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
        placed = running_sums(side, ["g", "y"], "left")
        # the left weight of a group and of those before it: groups are at most as many as ranges
        whole = placed.groupBy("g").agg(F.max("upto").alias("whole"))
        total += placed.join(F.broadcast(whole), "g").agg(F.sum(F.col("right") * (F.col("whole") - F.col("upto")))).first()[0] or 0.0
        width *= 2
    erased(ranged)
    return total
