"""Columns of any name beside, and as, those that operators read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.llm import chat, licenses, media, urlfilter


def test_dotted_and_clashing_names(spark):
    odd = lambda df: df.withColumn("a.b", F.lit("x")).withColumn("row", F.lit("r")).withColumn("_text", F.lit("t"))
    docs = odd(spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None)], "doc_id long, text string"))
    assert sorted(str(r.licenses) for r in licenses.license_scan(docs).collect()) == ["", "MIT/short", "MIT/short"] and licenses.license_scan(docs.limit(0)).count() == 0
    named = docs.withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "id.x")
    assert licenses.license_scan(named, "id.x", "the.text").count() == 3
    sniffed = media.sniff_media(odd(spark.createDataFrame([(bytearray(b"GIF89a"), "image/png")], "data binary, declared string")), "data", "declared")
    assert sniffed.select("`a.b`", "row", "_text").first() == ("x", "r", "t") and "media_type" in sniffed.columns
    assert media.text_as_media(docs).count() == 3
    talk = odd(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "`c.id` long, turn int, role string, text string"))
    assert chat.formatted(talk, conv_col="c.id").filter("loss").count() >= 1 and chat.formatted(talk.limit(0), conv_col="c.id").count() == 0
    pages = odd(spark.createDataFrame([(1, "http://a.example.com/en/1"), (2, "HTTPS://A.example.com:443/en/1/?utm_source=x#top"), (3, None)], "page_id long, `u.rl` string"))
    listed = spark.createDataFrame([("https://www.a.example.com/en/1",)], "`l.url` string")
    out = {r.page_id: r.verdict for r in urlfilter.judged(pages, listed, url_col="u.rl", listed_col="l.url").collect()}
    assert out == {1: "block", 2: "block", 3: "allow"}
