from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), brute.hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def planted(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts with passages in common, whole copies, periodic stretches and letters of several bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(passages), " ".join(word() for _ in range(rng.randint(1, 80))), "ab " * rng.randint(1, 90), "z" * rng.randint(1, 250)]) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice([*texts, " ".join(parts)]) if rng.random() < 0.2 else " ".join(parts))
    ids = rng.sample(range(-5, 5 * n), n)
    return list(zip(ids, texts, strict=True))


def test_equal_strings_have_one_anchor(monkeypatch):
    monkeypatch.setattr(substrings, "PART_BITS", 8)
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(700)) + b"x" * 300 + bytes(rng.choice(b"ab") for _ in range(333))
    common = np.random.default_rng(1).random(1 << substrings.TABLE_BITS) < 0.3
    h, place, first, last = substrings.pieces_of(text, common, 100)
    assert first[0] == 0 and last[-1] == len(text) - 100 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + substrings.GRAM <= first + 100).all()
    for k, a, p, z in zip(h.tolist(), first.tolist(), place.tolist(), last.tolist(), strict=True):
        for start in range(a, z + 1):
            other = substrings.pieces_of(b"pad" + text[start : start + 100], common, 100)
            assert other[1][-1] - 3 == p - start and other[0][-1] == k


@pytest.mark.parametrize("seed", range(3))
def test_later_strings_by_columns(seed):
    rng = random.Random(seed)
    length, width = 70, 70 - substrings.GRAM + 1
    rows = []
    for g in range(5):
        base = bytes(rng.choice(b"ab\x00") for _ in range(width - 1 + length))
        for _ in range(rng.randint(1, 30)):
            b = bytearray(base)
            for _ in range(rng.randint(0, 2)):
                b[rng.randrange(len(b))] = rng.choice(b"ab\x00")
            lo, starts = rng.randrange(width), rng.randint(1, width)
            hi = min(lo + starts, width) - 1
            rows.append((g, width - 1 - lo, bytes(b[lo : hi + length]), lo, hi))
    order = np.array([rng.randrange(40) for _ in rows])
    later = substrings.later_strings([r[2] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), order, length)
    for k, (g, _, piece, lo, hi) in enumerate(rows):
        for c in range(width):
            own = piece[c - lo : c - lo + length]
            want = lo <= c <= hi and any(o[0] == g and o[3] <= c <= o[4] and o[2][c - o[3] : c - o[3] + length] == own and order[j] < order[k] for j, o in enumerate(rows))
            assert later[k, c] == want


@pytest.mark.parametrize(("seed", "chunk", "block"), [(1, 8 << 20, 32_768), (2, 2_000, 3), (3, 500, 40)])
def test_kept_bytes_equal_brute_force(spark, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BLOCK_PIECES", block)
    docs = planted(seed, 90)
    got = found(substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert got == brute.repeated_strings(docs) and sum(x[1] for x in got.values()) > 1000


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.QUERIES["op12_repeated_strings"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == brute.repeated_strings(docs)


def test_odd_rows(spark):
    line = "the same line of words in many documents, longer than a hundred bytes, so that all but one of them lose it "
    rows = [(5, line), (None, line + "x"), (3, None), (4, ""), (6, "short"), (2, line), (2, line), (9, "q" * 50_000), (7, "é" * 60), (8, "é" * 60 + "\x00" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("chunk", "a.b", "_key", "hash"):
        docs = docs.withColumn(name, F.lit(1))
    out = sorted((tuple(r)[:1] + (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in substrings.without_repeats(docs).collect()), key=str)
    n = len(line)
    assert out == sorted([(5, n, n, [(0, n)]), (None, n + 1, n, [(0, n)]), (3, 0, 0, []), (4, 0, 0, []), (6, 5, 0, []), (2, n, 0, []), (2, n, 0, []), (9, 50_000, 49_999, [(1, 50_000)]), (7, 120, 118, [(2, 120)]), (8, 240, 239, [(0, 120), (121, 240)])], key=str)
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(docs, length=40)
