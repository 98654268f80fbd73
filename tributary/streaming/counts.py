"""The count table as a stream: late rows within the watermark still count, and each site and date is emitted once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import allele_fraction, canonicalize_strict


def daily_fractions(stream: DataFrame, time_col: str = "ts", late: str = "2 days") -> DataFrame:
    """(site_id, window, mutation, count, coverage, af) by day, for append mode. stream: site_id, mutation, count, coverage and a time."""
    clean = stream.withColumn("mutation", canonicalize_strict(F.col("mutation"))).withColumn("count", F.least("count", "coverage"))
    g = clean.withWatermark(time_col, late).groupBy("site_id", F.window(time_col, "1 day"), "mutation").agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))
    return g.withColumn("af", allele_fraction(F.col("count"), F.col("coverage")))
