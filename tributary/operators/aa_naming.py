"""Amino-acid names of nucleotide substitutions: a broadcast range join to reading frames and two codon lookups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import located

# Reading frames of the reference genome, 0-based and half-open; of overlapping frames the first counts.
ORFS: tuple[tuple[str, int, int], ...] = (
    ("orf1a", 265, 13468),
    ("orf1b", 13467, 21555),
    ("S", 21562, 25384),
    ("orf3a", 25392, 26220),
    ("E", 26244, 26472),
    ("M", 26522, 27191),
    ("orf6", 27201, 27387),
    ("orf7a", 27393, 27759),
    ("orf7b", 27755, 27887),
    ("orf8", 27893, 28259),
    ("N", 28273, 29533),
    ("orf10", 29557, 29674),
)
#: The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT ...
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = ["".join(x) for x in product("TCAG", repeat=3)]


def codon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(CODONS, AMINO_ACIDS, strict=True)), "codon string, amino string")


def read_fasta(spark: SparkSession, path: str) -> str:
    """The first sequence of a FASTA file, in upper case; a genome is small enough for the driver."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    heads = [i for i, x in enumerate(lines) if x.startswith(">")]
    body = lines[heads[0] + 1 : heads[1] if len(heads) > 1 else None] if heads else lines
    return "".join(x.strip().upper() for x in body)


def named_substitutions(df: DataFrame, genome: str, column: str = "mutation", orfs: Sequence[tuple[str, int, int]] | DataFrame = ORFS) -> DataFrame:
    """df with aa_name and aa_status (ok, malformed, out_of_range, ref_mismatch). Synonymous changes, places outside all frames and codons
    with other letters than ACGT keep the nucleotide name; names that aren't ok have a null aa_name. orfs: (name, left, right), the first that holds a place counts; or a table
    (rank, left, right, label) of any number of frames, which is indexed.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(column).alias("name")).withColumns({"ref": F.regexp_extract("name", "^([ACGT])([0-9]+)([ACGT])$", 1), "pos1": F.regexp_extract("name", "^([ACGT])([0-9]+)([ACGT])$", 2).try_cast("long"), "alt": F.regexp_extract("name", "^([ACGT])([0-9]+)([ACGT])$", 3)})
    rows = rows.withColumn("pos", F.col("pos1") - 1)
    base = F.substring(F.lit(genome), F.col("pos1").cast("int"), F.lit(1))
    status = F.when((F.coalesce("ref", F.lit("")) == "") | F.col("pos1").isNull(), "malformed").when((F.col("pos") < 0) | (F.col("pos") >= len(genome)), "out_of_range").when(base != F.col("ref"), "ref_mismatch").otherwise("ok")
    rows = rows.withColumn("aa_status", status)
    if isinstance(orfs, DataFrame):
        rows = located(rows, "pos", orfs, "held").withColumn("frame", F.when(F.col("aa_status") == "ok", F.col("held"))).withColumn("frame", F.struct(F.col("frame.label").alias("orf"), F.col("frame.left").alias("left")))
    else:
        # a dozen frames in a literal: the first that holds the place, without a join
        frames = F.array(*(F.struct(F.lit(n).alias("orf"), F.lit(a).alias("left"), F.lit(b).alias("right")) for n, a, b in orfs))
        rows = rows.withColumn("frame", F.when(F.col("aa_status") == "ok", F.get(F.filter(frames, lambda f: (f["left"] <= F.col("pos")) & (F.col("pos") < f["right"])), 0)))
    at = (F.col("pos") - F.col("frame.left")).cast("int")
    rows = rows.withColumns({"codon_at": (at / 3).cast("int"), "within": at % 3})
    rows = rows.withColumn("codon", F.substring(F.lit(genome), (F.col("frame.left") + 3 * F.col("codon_at") + 1).cast("int"), F.lit(3)))
    rows = rows.withColumn("changed", F.overlay("codon", "alt", (F.col("within") + 1).cast("int"), F.lit(1)))
    table = codon_table(spark)  # 64 rows
    for c, out in (("codon", "was"), ("changed", "is")):
        rows = rows.join(F.broadcast(table.select(F.col("codon").alias(c), F.col("amino").alias(out))), c, "left")
    new = F.concat(F.lit("aa:"), F.col("frame.orf"), F.lit(":"), F.col("was"), (F.col("codon_at") + 1).cast("string"), F.col("is"))
    name = F.when(F.col("aa_status") != "ok", F.lit(None).cast("string")).when(F.col("was").isNull() | F.col("is").isNull() | (F.col("was") == F.col("is")), F.col("name")).otherwise(new)
    keep = [c for c in df.columns if c not in ("aa_name", "aa_status")]
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), name.alias("aa_name"), "aa_status")
