"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one: each edge (u, v) then joins u to its root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Each round writes its edges to the shared folder, which cuts the lineage. A node with many edges costs no task more than
    its share: minima are taken map-side first, and the join back is one that Spark splits when it is skewed.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = saved(small, "edges")
        dropped(edges)
        dropped(large)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components after links (a, b) are added to those of roots.

    Only what the links join is worked on, as links between roots; the other components keep theirs.
    """
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    ends = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(ends)
    to = up.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.unionByName(up.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return saved(known.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
