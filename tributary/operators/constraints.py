"""Constraints as rows: what a table must satisfy, compiled into one pass over each table, one aggregation for each key and one anti-join for each reference.

A check is (table, check, kind, argument). Kinds: column (the table has it), text, number, day, truth (the column's type; the argument is the column), text_values (rows of a column that
isn't text), rows (a SQL condition that no row may meet; null doesn't count), unique (columns), filled (the table has rows), refers (columns -> table columns: every
value that isn't null is there). A table that lacks a column of its checks gets its column checks alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import text_bool

RESULT = "table string, check string, passed boolean, details string"


class Check(NamedTuple):
    table: str
    check: str
    kind: str
    argument: str = ""


def _text(table: str, *columns: str) -> list[Check]:
    return [x for c in columns for x in (Check(table, f"{c}_is_string_dtype", "text", c), Check(table, f"{c}_values_are_str_or_na", "text_values", c))]


def _columns(table: str, *columns: str) -> list[Check]:
    return [Check(table, f"has_column:{c}", "column", c) for c in columns]


#: What the stages rely on.
CHECKS = [
    *_columns("snv", "sample_id", "site_id", "date", "mutation", "count", "coverage"),
    Check("snv", "date_is_day", "day", "date"),
    Check("snv", "date_is_normalized_daily", "rows", "date <> date_trunc('day', date)"),
    *_text("snv", "sample_id", "site_id", "mutation"),
    *(x for c in ("count", "coverage") for x in (Check("snv", f"{c}_is_numeric", "number", c), Check("snv", f"{c}_nonnegative", "rows", f"{c} < 0"))),
    Check("snv", "count_le_coverage", "rows", "count > coverage"),
    Check("snv", "mutation_char_set_ok", "rows", r"not mutation rlike '^[A-Z0-9:_\\-]*$'"),
    Check("snv", "key_unique_after_dedup", "unique", "site_id date sample_id mutation"),
    Check("snv", "non_empty_table", "filled"),
    *_columns("signatures", "mutation", "lineage", "weight"),
    *_text("signatures", "mutation", "lineage"),
    Check("signatures", "weight_is_numeric", "number", "weight"),
    Check("signatures", "weight_equals_1", "rows", "weight is null or weight <> 1"),
    Check("signatures", "mutation_lineage_unique", "unique", "mutation lineage"),
    Check("signatures", "non_empty_table", "filled"),
    *_columns("lineages", "lineage", "label", "is_voc", "notes"),
    *_text("lineages", "lineage", "label", "notes"),
    Check("lineages", "is_voc_bool_or_coercible", "truth", "is_voc"),
    Check("lineages", "non_empty_table", "filled"),
    Check("signatures", "lineage_is_listed", "refers", "lineage -> lineages lineage"),
]

_TYPES = {"text": T.StringType, "number": T.NumericType, "day": (T.DateType, T.TimestampType, T.TimestampNTZType)}


def validated(tables: dict[str, DataFrame], checks: Sequence[Check] = tuple(CHECKS)) -> DataFrame:
    """(table, check, passed, details) of the checks whose table is given; references to a table that isn't given are left out."""
    out: DataFrame | None = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        own = [c for c in checks if c.table == name]
        kinds = {f.name: f.dataType for f in df.schema}
        fixed = [(name, c.check, c.argument in kinds, "") for c in own if c.kind == "column"]
        if all(passed for _, _, passed, _ in fixed):
            fixed += [(name, c.check, isinstance(kinds[c.argument], _TYPES[c.kind]), f"type={kinds[c.argument].simpleString()}") for c in own if c.kind in _TYPES]
            add(_counted(name, df, own, kinds))
            for c in own:
                if c.kind == "unique":
                    more = df.groupBy(*c.argument.split()).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v"))
                    add(_row(name, c.check, more, "duplicates"))
                elif c.kind == "refers":
                    columns, _, there = c.argument.partition(" -> ")
                    other, *keys = there.split()
                    if other in tables:
                        mine = columns.split()
                        wanted = df.select(*(F.col(m).alias(k) for m, k in zip(mine, keys, strict=True))).na.drop()
                        add(_row(name, c.check, wanted.join(tables[other].select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("v")), "unlisted"))
        add(spark.createDataFrame(fixed, RESULT))
    return out


def _row(table: str, check: str, counted: DataFrame, word: str) -> DataFrame:
    return counted.select(F.lit(table).alias("table"), F.lit(check).alias("check"), (F.col("v") == 0).alias("passed"), F.concat(F.lit(f"{word}="), F.col("v")).alias("details"))


def _counted(name: str, df: DataFrame, own: Sequence[Check], kinds: dict[str, T.DataType]) -> DataFrame:
    """All checks of a table that are counts of its rows, in one pass."""
    counts = {}
    for c in own:
        if c.kind == "rows":
            counts[c.check] = ("violations", F.count_if(F.expr(c.argument)))
        elif c.kind == "text_values":
            counts[c.check] = ("violations", F.lit(0).cast("long") if isinstance(kinds[c.argument], T.StringType) else F.count(c.argument))
        elif c.kind == "truth":
            counts[c.check] = ("na_after_coercion", F.count_if(text_bool(F.col(c.argument).cast("string")).isNull()))
        elif c.kind == "filled":
            counts[c.check] = ("rows", F.count(F.lit(1)))
    one = df.agg(*(x.alias(f"_{i}") for i, (_, x) in enumerate(counts.values())))
    entries = [F.struct(F.lit(name).alias("table"), F.lit(check).alias("check"), (F.col(f"_{i}") > 0 if word == "rows" else F.col(f"_{i}") == 0).alias("passed"), F.concat(F.lit(f"{word}="), F.col(f"_{i}")).alias("details")) for i, (check, (word, _)) in enumerate(counts.items())]
    return one.select(F.inline(F.array(*entries)))


def lineage_store(lineages: DataFrame) -> DataFrame:
    """The lineage table as it is kept: is_voc as truth values, where it can be read as such; else null."""
    return lineages.withColumn("is_voc", text_bool(F.col("is_voc").cast("string")))
