"""Registers queries with their oracle SQL, and evens out what two engines may print differently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; integers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(name) if kind in ("double", "float") else c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


def oracle(sql: str, doubles: str = "", longs: str = "", digits: int = 6) -> str:
    parts = [f"round(cast({c} as double), {digits}) + 0.0 AS {c}" for c in doubles.split()] + [f"cast({c} AS bigint) AS {c}" for c in longs.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; its doubles are rounded as those of the SQL are."""

    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql, doubles, longs, digits)
        return f

    return put
