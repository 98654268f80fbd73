from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import queries, tandem

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a a a a a a", "été " * 9, "x " * 300 + "y", "\x00 " * 8, "a a a a a a a a a a a a"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(150):
        texts = [[rng.choice(b"abc"[:letters].decode()).encode() for _ in range(rng.randint(0, 40))] for _ in range(4)]
        s, starts = tandem.word_ids(texts)
        for least in ((2, 2), (6, 4)):
            got = sorted(zip(*(x.tolist() for x in tandem.maximal_runs(s, *least)), strict=True))
            assert got == sorted((a + starts[d], n, q) for d, t in enumerate(texts) for a, n, q in brute.runs(t, *least))


def test_long_periods_and_powers():
    rng = random.Random(7)
    unit = [b"%d" % rng.randint(0, 50) for _ in range(90)]
    words = [b"x"] * 30 + unit * 5 + unit[:17] + [b"y"] + (unit[:2] * 3) * 4
    s, _ = tandem.word_ids([words])
    assert sorted(zip(*(x.tolist() for x in tandem.maximal_runs(s, 6, 4)), strict=True)) == brute.runs(words)
    assert len(tandem.maximal_runs(np.arange(5), 2, 2)[0]) == 0


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(out) == len(docs) and sum(r.n_runs for r in out) > 0
    for r in out:
        assert tuple(r)[1:] == brute.runs_row(r.doc_id, docs[r.doc_id]), r.doc_id


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tandem, "BLOCK_WORDS", 20)
    rows = [*enumerate(ODD), (None, "b b b b b b b"), (None, None), (3, "one"), (3, "c " * 50)] + [(i, "p q r " * 30 + "s t " * 20) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "a.b", "_text", "collapsed"):
        docs = docs.withColumn(name, F.lit(1))
    got = rows_of(queries.runs_of(docs).drop("doc_id"))
    assert got == sorted((brute.runs_row(*r) for r in rows), key=str)
    out = tandem.periodic_runs(spark.createDataFrame([("k", "z z z z z z z w")], "doc_id string, text string")).collect()[0]
    assert out.doc_id == "k" and out.n_words == 8 and [tuple(x) for x in out.runs] == [(0, 7, 1)] and out.collapsed == "z w"
    assert queries.runs_of(docs.limit(0)).count() == 0
