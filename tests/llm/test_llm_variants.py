from __future__ import annotations

import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from tributary.llm import queries, variants

SF = "/root/testdata/sf0.001"


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted({"".join(p) for n in range(1, 5) for p in itertools.product("abc", repeat=n)})
    a = variants.Automaton(words)
    # one state for each number of letters that may follow
    assert len(a) == 5 and [a.number(w) for w in words] == list(range(len(words)))
    assert a.number("abcab") == -1 and a.number("d") == -1
    a = variants.Automaton(["listen", "listens", "lists"])
    assert [a.number(w) for w in ("listen", "listens", "lists", "list")] == [0, 1, 2, -1]
    assert len(variants.Automaton([])) == 1 and variants.Automaton([]).one_error("abc", 0) == set()


def test_one_error_equals_brute_force():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 7))) for _ in range(120)})
    a = variants.Automaton(words)
    for w in [*words, "abababab", "b"]:
        for exact in range(len(w) + 1):
            want = {k for k, v in enumerate(words) if v[:exact] == w[:exact] and brute.one_apart(w, v)}
            got = a.one_error(w, exact)
            # an error before `exact` may look like one behind it, where letters repeat
            assert got == want, (w, exact)


@pytest.mark.parametrize("block", [100_000, 7])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 9))): rng.choice([1, 5, 5, 25, 125, 700]) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants.spelling_variants(df)) == brute.variants(words)


def test_chains_of_forms_end_at_one_root(spark):
    words = {"abcdef" + "ghijkl"[:k]: 5 ** (k + 1) for k in range(7)}
    out = found(variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[4] for r in out.values()} == {"abcdefghijkl"} and out["abcdef"][2] == "abcdefg" and out == brute.variants(words)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = found(queries.QUERIES["op13_spelling_variants"](spark, SF))
    assert out == brute.variants(brute.variant_words(docs)) and any(r[2] for r in out.values())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 3)
    texts = [None, "", " \n", "Straße straße STRASSE Ünder ünder", "漢字abc\U0001f600def x×y÷z ÀB ÿ", "don't re-run A1B2", "word " * 3000, "q" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, "lonely lonely"), (None, None)] + [(i, "a few words of text that slip") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w")).withColumn("a.b", F.lit(1))
    counts = variants.word_counts(docs, slip_every=199)
    assert {r.word: r.n for r in counts.collect()} == brute.variant_words(rows, 1, 1)
    assert variants.word_counts(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(none).count() == 0
    alone = spark.createDataFrame([("zebras", 9)], "word string, n long")
    assert found(variants.spelling_variants(alone)) == {"zebras": (9, 0, None, None, "zebras")}
