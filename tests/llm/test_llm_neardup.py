"""Work of the exact join by component, repeated rows, and which of tied rows stays."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tributary.llm import neardup

POSTS = "shingle long, at int, n int, node binary, root binary, earlier binary"
NONE = bytearray(8 * neardup.EARLIER)


def postings(spark, roots: dict[int, int]):
    """One shingle that so many sets of each component hold."""
    nodes = itertools.count()
    return spark.createDataFrame([(7, 0, 100, bytearray(next(nodes).to_bytes(16, "little")), bytearray([r]), NONE) for r, k in roots.items() for _ in range(k)], POSTS)


@pytest.mark.parametrize(("block", "roots"), [(4, {1: 30, 2: 1, 3: 2}), (4, {1: 9, 2: 9, 3: 9, 4: 1}), (512, {1: 70, 2: 3, 3: 90}), (3, dict.fromkeys(range(40), 1)), (2, {1: 5, 2: 5})])
def test_each_pair_of_components_meets_once(spark, monkeypatch, block, roots):
    monkeypatch.setattr(neardup, "BLOCK", block)
    posts = postings(spark, roots)
    keys = ("shingle", "x", "y")
    met = neardup.dealt(posts).repartition(3, *keys).sortWithinPartitions(*keys).mapInPandas(neardup._meetings(75), "a binary, b binary").collect()
    pairs = [(bytes(r.a), bytes(r.b)) for r in met]
    of = {bytes(r.node): bytes(r.root) for r in posts.collect()}
    assert sorted(pairs) == sorted((a, b) for a, b in itertools.combinations(sorted(of), 2) if of[a] != of[b])


def test_one_component_costs_no_rows(spark):
    assert neardup.dealt(postings(spark, {1: 3000})).count() == 0
    few, many = (neardup.dealt(postings(spark, {1: k, 2: 3})).count() for k in (1500, 6000))
    assert many <= 4 * few + 100


def test_repeated_rows_are_one_text(spark):
    rng = random.Random(1)
    words = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = [(1, " ".join(words))] * 40 + [(2, " ".join([*words, "more"]))] * 40 + [(None, " ".join(words))] * 5
    seen = []
    real = neardup.confirmed
    try:
        neardup.confirmed = lambda pairs, texts, width, percent: (seen.append((texts.count(), texts.select("node").distinct().count())), real(pairs, texts, width, percent))[1]
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        neardup.confirmed = real
    assert len(out) == 85 and {r.component_id for r in out} == {1} and all(a == b for a, b in seen)


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    t = "one text of seven words or so"
    rows = [(1, t, f"s{k}", {"k": k}) for k in range(20)]
    kept = {tuple(neardup.without_near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string, m map<string,int>").repartition(k + 1)).select("doc_id", "source", F.col("m.k")).first()) for k in (0, 3, 11)}
    assert len(kept) == 1
