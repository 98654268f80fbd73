"""Indexes of overlapping intervals: of those that hold a place the one of the lowest rank counts. Rows are located without a join over ranges.

Up to MOST intervals the index is one row that goes to every task: sorted places where the interval that counts changes, looked up by binary search in one array. Beyond it is a table of
dyadic ranges (level, node): an interval is cut into at most two ranges of each level, a range keeps the best of its intervals, and a place meets the one range of each level that holds it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Intervals that one index may have: some 100 bytes each in every task.
MOST = 200_000

_INDEX = "starts array<long>, holders array<struct<label:string,left:long,right:long>>"


def swept(intervals: list[tuple[int, int, int, str]]) -> tuple[list[int], list[tuple[str, int, int] | None]]:
    """(starts, holders): from each start on, the (label, left, right) of lowest (rank, left, right, label) among half-open intervals (rank, left, right, label), or None."""
    coming = sorted((x for x in intervals if x[1] < x[2]), key=lambda x: x[1])
    starts, holders, open_, k = [], [], [], 0
    for place in sorted({p for _, a, b, _ in coming for p in (a, b)}):
        while k < len(coming) and coming[k][1] == place:
            heapq.heappush(open_, coming[k])
            k += 1
        while open_ and open_[0][2] <= place:
            heapq.heappop(open_)
        holder = (open_[0][3], open_[0][1], open_[0][2]) if open_ else None
        if not holders or holders[-1] != holder:
            starts.append(place)
            holders.append(holder)
    return starts, holders


def _usable(intervals: DataFrame) -> DataFrame:
    """(rank, left, right, label) without rows with a null bound or label; a null rank comes last."""
    return intervals.select(F.coalesce(F.col("rank").cast("long"), F.lit(2**62)).alias("rank"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.col("label").cast("string").alias("label")).na.drop()


def interval_index(intervals: DataFrame, most: int = MOST) -> DataFrame:
    """One row (starts, holders) from (rank, left, right, label); rows with a null bound or label are left out, empty intervals hold nothing. More than `most` are an error."""
    good = _usable(intervals)
    if (n := good.count()) > most:
        raise ValueError(f"{n} intervals; an index holds {most}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [swept([(x["rank"], x["left"], x["right"], x["label"]) for x in intervals]) for intervals in b["all"]]
            yield pd.DataFrame({"starts": [s for s, _ in each], "holders": [[h and {"label": h[0], "left": h[1], "right": h[2]} for h in hs] for _, hs in each]})

    return good.agg(F.collect_list(F.struct("rank", "left", "right", "label")).alias("all")).mapInPandas(run, _INDEX)


def holder_at(place: Column, starts: Column, holders: Column) -> Column:
    """struct<label, left, right> of the interval that counts at a place, null where none holds it: the last start up to the place, by halving."""
    halve = lambda s, _: F.when(F.get(starts, s["mid"] - 1) <= place, F.struct(s["mid"].alias("lo"), s["hi"].alias("hi"), F.floor((s["mid"] + s["hi"] + 1) / 2).cast("int").alias("mid"))).otherwise(F.struct(s["lo"].alias("lo"), (s["mid"] - 1).alias("hi"), F.floor((s["lo"] + s["mid"]) / 2).cast("int").alias("mid")))
    n = F.size(starts)
    steps = F.ceil(F.log2(n + 1.0)).cast("int")
    first = F.struct(F.lit(0).alias("lo"), n.alias("hi"), F.floor((n + 1) / 2).cast("int").alias("mid"))
    found = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), first, halve)["lo"]
    return F.when((n > 0) & place.isNotNull(), F.get(holders, found - 1))


def _up(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def dyadic_index(intervals: DataFrame) -> DataFrame:
    """(level, node, best struct<rank, left, right, label>) of intervals in any number: node k of a level is the places from k * 2 ** level to (k + 1) * 2 ** level - 1.

    An interval's ranges are those of its longest cut into whole nodes, so a place in it lies in exactly one of them. Empty intervals have none.
    """

    def cut(level: Column) -> Column:
        # the first node that begins in the interval, and the one after the last that ends in it
        down = _up(F.col("left"), level)
        low = down + F.when(F.call_function("shiftleft", down, level) != F.col("left"), 1).otherwise(0)
        high = _up(F.col("right"), level)
        node = lambda odd, at: F.when((low < high) & (odd.bitwiseAND(F.lit(1)) != 0), F.struct(level.alias("level"), at.alias("node")))
        return F.array(node(low, low), node(high, high - 1))

    # no node is wider than its interval; one level more for the rounding of the width
    most = F.least(F.floor(F.log2(F.col("right").cast("double") - F.col("left").cast("double"))).cast("int") + 1, F.lit(63))
    cells = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), most), cut)), lambda c: c.isNotNull())
    each = _usable(intervals).filter(F.col("left") < F.col("right")).select(F.struct("rank", "left", "right", "label").alias("best"), F.inline(cells))
    return each.groupBy("level", "node").agg(F.min("best").alias("best"))


def _located_far(df: DataFrame, place: str, intervals: DataFrame, name: str) -> DataFrame:
    """located() by the dyadic index: each distinct place once, at the levels that have nodes."""
    index = written(dyadic_index(intervals), "intervals")
    levels = sorted(r.level for r in index.select("level").distinct().collect())
    places = df.select(F.col(place).cast("long").alias("_place")).filter("_place is not null").distinct()
    asked = places.select("_place", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")).withColumn("node", _up(F.col("_place"), F.col("level")))
    best = asked.join(index, ["level", "node"]).groupBy("_place").agg(F.min("best").alias("_best")).select("_place", F.struct("_best.label", "_best.left", "_best.right").alias(name))
    return df.join(best, F.col(place).cast("long") == F.col("_place"), "left").drop("_place")


def located(df: DataFrame, place: str, intervals: DataFrame, name: str = "holder", most: int = MOST) -> DataFrame:
    """df with a column of the interval that counts at its place: by the one-row index for up to `most` intervals, by the dyadic one for more."""
    if _usable(intervals).limit(most + 1).count() > most:
        return _located_far(df, place, intervals, name)
    return df.crossJoin(F.broadcast(interval_index(intervals, most))).withColumn(name, holder_at(F.col(place), F.col("starts"), F.col("holders"))).drop("starts", "holders")
