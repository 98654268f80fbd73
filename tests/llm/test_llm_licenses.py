"""Notices within a line, and over lines and paragraphs, by windows around key words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.llm import licenses

APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("x"))
    return {r.doc_id: set(r.licenses.split(",")) - {""} for r in licenses.license_scan(df).collect()}


def test_published_header_inside_a_longer_text(spark):
    text = "Copyright 2024 The Authors\n\n" + APACHE + "\n\nimport os\n" + "x = 1  # plain code\n" * 60
    assert "Apache-2.0/header" in found(spark, text)[0]


def test_notice_inside_a_sentence(spark):
    out = found(spark, "This dataset was made by the data team in 2021 and is Released under the MIT License. More words follow here.", "It was released under some other license by them.", "released under the\nMIT\n\nlicense")
    assert out == {0: {"MIT/short"}, 1: set(), 2: {"MIT/short"}}


def test_full_texts_over_lines_and_with_small_changes(spark):
    mit, bsd = licenses.TEMPLATES["MIT/full"], licenses.TEMPLATES["BSD-2-Clause/full"]
    wrapped = "\n".join(" ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    changed = bsd.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS")
    out = found(spark, "# tool\n\n" + wrapped + "\n\nMore text of another kind.", "words before " + changed + " words behind", mit[: len(mit) // 2] + " stops here")
    assert "MIT/full" in out[0] and "BSD-2-Clause/full" in out[1] and "MIT/full" not in out[2]


def test_repeated_rows_and_long_texts(spark):
    note = licenses.TEMPLATES["ISC/permission"]
    out = found(spark, note, note, None, "", "word " * 30_000 + note + " word" * 30_000)
    assert out[0] == out[1] and "ISC/permission" in out[4] and out[2] == out[3] == set()
