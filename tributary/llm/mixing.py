"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of their sources); the
capacity of a pattern is its tokens. In the flow network, every pattern has one arc for each repetition, of its capacity, with
costs that rise convexly (the k-th repetition costs k * k), an arc to each of its sources, and each source has an arc of its quota to the sink. The
cheapest largest flow says how many tokens each pattern gives to each source. The network holds patterns and sources only, so it is
solved on the driver; its size depends on the number of distinct patterns, not on the documents.

Selection: the documents of a pattern lie in a seeded order on a line of the pattern's length, which repeats. Source after source
takes its flow from the line. A document wholly inside a share counts whole; the one at a share's end gives the tokens inside it.
To place documents without sorting a hot pattern in one task, the line is cut into `BUCKETS` hash buckets: bucket totals give the
offsets, only buckets that hold an end of a share are ordered, and all other documents are decided by their bucket's number.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, saved

BUCKETS = 65_536
REPEATS = 3
#: `[^\x20\x09-\x0D]+`
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sizes: Sequence[int], weights: Sequence[float], most: float = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * its size; what is over is shared again by weight."""
    targets, free, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(sum(sizes))
    while free and left > 0:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each source: the cheapest of the largest flows, by successive shortest paths.

    patterns: tokens of each tuple of sources. quotas: tokens wanted by each source.
    """
    names = [("s",), *(("p", p) for p in patterns), *(("q", q) for q in quotas), ("t",)]
    at = {x: i for i, x in enumerate(names)}
    graph: list[list[list]] = [[] for _ in names]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, tokens in patterns.items():
        for k in range(1, repeats + 1):
            arc(0, at["p", p], tokens, k * k)
        for q in p:
            if q in quotas:
                arc(at["p", p], at["q", q], repeats * tokens, 0)
    for q, tokens in quotas.items():
        arc(at["q", q], at["t",], tokens, 0)
    end, height = at["t",], [0] * len(names)
    while True:
        far, via, queue = [float("inf")] * len(names), {}, [(0, 0)]
        far[0] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                step = d + cost + height[a] - height[b]
                if capacity > 0 and step < far[b]:
                    far[b], via[b] = step, (a, i)
                    heapq.heappush(queue, (step, b))
        if far[end] == float("inf"):
            break
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        push, b = float("inf"), end
        while b:
            a, i = via[b]
            push, b = min(push, graph[a][i][1]), a
        b = end
        while b:
            a, i = via[b]
            graph[a][i][1] -= push
            graph[b][graph[a][i][3]][1] += push
            b = a
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for p in patterns:
        for b, _, cost, back in graph[at["p", p]]:
            if names[b][0] == "q" and cost == 0 and graph[b][back][1] > 0:
                flow[p][names[b][1]] = graph[b][back][1]
    return flow


def mixed(docs: DataFrame, id_cols: Sequence[str], sources_col: str, size_col: str, quotas: dict, seed: int = 0, repeats: int = REPEATS) -> DataFrame:
    """docs with a column `takes`: array<struct<source string, taken long>>, the tokens each source takes of the document.

    sources_col: array of source names (repeats within it count once; null or empty: the document gives nothing). Names are strings; null is a name of its own.
    quotas: tokens wanted by source name (None for null). Sizes that are null or below 1 give nothing. Documents with equal
    id_cols and size lie at one place of the line, in the order of a hash of their columns. Sources without documents get nothing.
    """
    spark = docs.sparkSession
    names = F.transform(F.array_distinct(F.coalesce(F.col(sources_col), F.array().cast("array<string>"))), lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), x)))
    place = F.xxhash64(F.lit(seed), *id_cols)
    # the columns of docs travel in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), F.array_sort(names).alias("_pattern"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("_size"), place.alias("_place"))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_place", 40), F.lit(BUCKETS)))
    totals = saved(rows.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("tokens")), "mix")
    key = {None: "-"}
    wanted = {key.get(q, f"+{q}"): int(round(t)) for q, t in quotas.items() if t > 0}
    patterns = {tuple(r[0]): r[1] for r in totals.groupBy("_pattern").agg(F.sum("tokens")).collect() if r[1] > 0}
    flow = min_cost_flow(patterns, wanted, repeats)
    cuts = []
    for p, tokens in sorted(patterns.items()):
        at = 0
        for q in sorted(flow[p]):
            for x, sign in ((at, -1), (at + flow[p][q], 1)):
                cuts.append((list(p), q, sign, x // tokens, x % tokens))
            at += flow[p][q]
    shape = T.StructType([T.StructField("_pattern", T.ArrayType(T.StringType())), T.StructField("q", T.StringType()), T.StructField("sign", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("x", T.LongType())])
    before = F.sum("tokens").over(Window.partitionBy("_pattern").orderBy("_bucket")) - F.col("tokens")
    starts = totals.withColumn("start", before).filter("tokens > 0")
    # each cut: the bucket that holds it, and how far into the bucket it lies
    found = spark.createDataFrame(cuts, shape).join(starts, "_pattern").filter("start <= x and x < start + tokens")
    table = found.groupBy("_pattern").agg(F.collect_list(F.struct("q", "sign", "turns", F.col("_bucket").alias("bucket"), (F.col("x") - F.col("start")).alias("into"))).alias("_cuts"))
    table = spark.createDataFrame(table.collect(), table.schema)  # one row for each pattern that gives something, as the flow has on the driver
    joined = rows.join(F.broadcast(table), "_pattern", "left")
    at_cut = F.exists("_cuts", lambda c: c["bucket"] == F.col("_bucket"))

    def takes(inside: Column) -> Column:
        # tokens of the line before the cut that are the document's: whole turns, then its part of the last
        part = lambda c: F.when(c["bucket"] > F.col("_bucket"), F.col("_size")).when(c["bucket"] < F.col("_bucket"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("_size"), c["into"] - inside)))
        of = lambda q: F.aggregate(F.filter("_cuts", lambda c: c["q"] == q), F.lit(0).cast("long"), lambda acc, c: acc + c["sign"] * (c["turns"] * F.col("_size") + part(c)))
        named = lambda q: F.when(q == "-", F.lit(None).cast("string")).otherwise(F.substring(q, 2, 1 << 30))
        each = F.transform(F.array_sort(F.array_distinct(F.transform("_cuts", lambda c: c["q"]))), lambda q: F.struct(named(q).alias("source"), of(q).cast("long").alias("taken")))
        return F.filter(F.coalesce(each, F.array().cast("array<struct<source:string,taken:bigint>>")), lambda x: x["taken"] > 0)

    whole = joined.filter(F.col("_cuts").isNull() | ~at_cut).select("_row", takes(F.lit(0).cast("long")).alias("takes"))
    order = Window.partitionBy("_pattern", "_bucket").orderBy("_place", "_size", F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = joined.filter(F.col("_cuts").isNotNull() & at_cut).withColumn("_inside", F.sum("_size").over(order) - F.col("_size"))
    partial = partial.select("_row", takes(F.col("_inside")).alias("takes"))
    return whole.unionByName(partial)


def source_quotas(docs: DataFrame, source_col: str, size_col: str, weights: Sequence[float] = (1, 2, 3), repeats: int = REPEATS) -> tuple[dict, dict]:
    """(targets, sizes) by source: sources by code point, null last, weigh as `weights` repeated and share 100% of all sizes."""
    sizes = {r[0]: int(r[1] or 0) for r in docs.groupBy(source_col).agg(F.sum(size_col)).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_filled([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], repeats)
    return dict(zip(names, targets, strict=True)), sizes


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: Sequence[float] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """docs with source_size, target and taken, for documents of one source each (null is a source).

    Empty docs give no rows. Repeated rows are documents of their own. Sources of size 0 have target 0. Columns of docs with one of the
    three names are replaced.
    """
    spark = docs.sparkSession
    targets, sizes = source_quotas(docs, source_col, size_col, weights)
    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    inner = docs.select(F.struct(*map(column, kept)).alias("row"), F.array(column(source_col)).alias("sources"), column(size_col).alias("tokens"), column(id_col).alias("key"), column(source_col).alias("of"))
    out = mixed(inner, ["key"], "sources", "tokens", targets, seed)
    table = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "of string, source_size long, target double")
    out = out.select("_row.row", "_row.of", F.coalesce(F.aggregate("takes", F.lit(0).cast("long"), lambda acc, x: acc + x["taken"]), F.lit(0)).alias("taken"))
    # one row for each source, as source_quotas has on the driver
    return out.join(F.broadcast(table).alias("t"), out["of"].eqNullSafe(F.col("t.of")), "left").select("row.*", "source_size", "target", "taken")


__all__ = ["min_cost_flow", "mix_by_source", "mixed", "source_quotas", "water_filled", "word_count"]
