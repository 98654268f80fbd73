from __future__ import annotations

import brute
from pyspark.sql import functions as F

import corpus_pipeline as P
from tributary.llm import quality
from tributary.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, None
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r for r in docs.collect()}
        assert k == 4 or docs.columns == columns
        if k == 0:
            scores = {r.doc_id: r.score for r in quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), ["doc_id"]).collect()}
            assert set(rows) == {i for i in before if scores[i] >= quality.THRESHOLD} and len(rows) < len(before)
        elif k == 1:
            groups = brute.near_duplicates([(i, r.text) for i, r in before.items()])
            assert set(rows) == {i for i, x in groups.items() if x[1] == i}
        elif k == 2:
            found = brute.contamination([(i, r.text) for i, r in before.items()], bench)
            assert set(rows) == {i for i, x in found.items() if not x[4]}
        elif k == 3:
            assert set(rows) == set(before) and all(not brute.secrets_base(r.text) and r.n_chars == len(r.text) for r in rows.values())
            assert all(rows[i].text == r.text for i, r in before.items() if "[SECRET]" not in rows[i].text)
    sources = {r.source: r for r in rows.values()}
    for s, r in sources.items():
        assert abs(sum(x.taken for x in rows.values() if x.source == s) - r.target) <= 1
    whole = P.run(spark, SF).select("doc_id", "taken")
    assert sorted(map(tuple, whole.collect())) == sorted((i, r.taken) for i, r in rows.items())


def test_pipeline_is_registered_and_survives_odd_rows(spark):
    assert "pipeline" in QUERIES and P.ORACLE_SQL is None
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a few plain words in a row", "en", None, 26)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.filter("doc_id = 2").count() == 1


def test_stages_of_empty_tables_and_odd_names(spark):
    docs = spark.createDataFrame([(1, "a few plain words in a row", "en", "s", 26), (2, "some other plain words in a row", "en", "s", 31)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("a.b", "_kept_id", "_bad_key", "row", "_text"):
        docs = docs.withColumn(name, F.lit(name))
    for table in (docs, docs.limit(0)):
        rows = table.count()
        for k, (_, stage) in enumerate(P.STAGES):
            before, table = table, stage(spark, table, SF)
            assert table.columns[: len(docs.columns)] == before.columns and table.count() == rows, k
            assert all(r["a.b"] == "a.b" and r["_kept_id"] == "_kept_id" and r["row"] == "row" for r in table.collect())
