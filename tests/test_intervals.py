"""Overlapping intervals: the index against a look at all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import aa_naming as N
from tributary.operators import intervals as I


def test_located_equals_a_look_at_all(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1000):
        a = rng.randrange(20_000)
        rows.append((rng.randrange(50), a, a + rng.choice([0, 1, 5, 300, 9000, -4]), f"f{k}"))
    rows += [(None, 25_000, 25_010, "last"), (1, None, 5, "x"), (1, 2, 3, None)]
    df = spark.createDataFrame(rows, '`rank` long, `left` long, `right` long, label string')
    places = [rng.randrange(-10, 30_000) for _ in range(400)] + [25_005, None]
    out = I.located(spark.createDataFrame([(p,) for p in places], "place long"), "place", df).collect()
    good = [(r if r is not None else 2**62, a, b, n) for r, a, b, n in rows if None not in (a, b, n)]
    for r in out:
        best = min((x for x in good if r.place is not None and x[1] <= r.place < x[2]), default=None)
        assert (r.holder and (r.holder.label, r.holder.left, r.holder.right)) == (best and (best[3], best[1], best[2]))


def test_no_intervals_and_too_many(spark):
    df = spark.createDataFrame([(1, 2, 5, "a"), (1, 3, 9, "b")], '`rank` long, `left` long, `right` long, label string')
    one = spark.createDataFrame([(4,)], "place long")
    assert I.located(one, "place", df.limit(0)).first().holder is None and I.located(one, "place", df).first().holder.label == "a"
    with pytest.raises(ValueError):
        I.interval_index(df, 1)


def test_names_are_the_same_with_frames_from_a_table(spark):
    genome = ("ATGGCTTGGAACGTTAGCCATCAATTGTAAGCACCGGATTTC" * 712)[:29903]
    names = spark.createDataFrame([(f"{genome[p]}{p + 1}{a}",) for p in range(0, 29903, 97) for a in "AC"] + [("A40000C",), ("x",)], "mutation string")
    table = spark.createDataFrame([(k, a, b, n) for k, (n, a, b) in enumerate(N.ORFS)], '`rank` long, `left` long, `right` long, label string')
    pairs = [sorted(tuple(map(str, r)) for r in N.named_substitutions(names, genome, orfs=o).select("mutation", "aa_name", "aa_status").collect()) for o in (N.ORFS, table)]
    assert pairs[0] == pairs[1] and any(F and x[1].startswith("aa:") for x in pairs[0])


def test_more_intervals_than_one_row_holds(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        a = rng.randrange(-2000, 20_000)
        rows.append((rng.randrange(50), a, a + rng.choice([0, 1, 5, 300, 9000, -4]), f"f{k}"))
    rows += [(None, 25_000, 25_010, "last"), (1, None, 5, "x"), (1, 2, 3, None), (3, -(2**63), -(2**62), "low"), (3, 2**62, 2**63 - 1, "high"), (60, -(2**63), 2**63 - 1, "all but the last")]
    df = spark.createDataFrame(rows, '`rank` long, `left` long, `right` long, label string')
    places = [rng.randrange(-3000, 30_000) for _ in range(400)] * 2 + [25_005, None, -(2**63), 2**63 - 1, 2**63 - 2, 2**62, 2**62 - 1, -(2**62), -1, 0]
    out = I.located(spark.createDataFrame([(p,) for p in places], "place long"), "place", df, most=10).collect()
    good = [(r if r is not None else 2**62, a, b, n) for r, a, b, n in rows if None not in (a, b, n)]
    assert len(out) == len(places)
    for r in out:
        best = min((x for x in good if r.place is not None and x[1] <= r.place < x[2]), default=None)
        assert (r.holder and (r.holder.label, r.holder.left, r.holder.right)) == (best and (best[3], best[1], best[2]))
    assert I.located(spark.createDataFrame([(4,)], "place long"), "place", df.filter("right <= left"), most=0).first().holder is None
