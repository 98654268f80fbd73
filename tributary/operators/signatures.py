"""Binary mutation-to-lineage signatures, kept long; wide only where a solver needs a matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.scalars import betaln, normalize_mutation, stripped

GLOBAL = "GLOBAL"


def normalized_signatures(raw: DataFrame) -> DataFrame:
    """Distinct (mutation, lineage, weight 1). Null and blank names go; a weight other than 1 fails when the rows are read."""
    for c in ("mutation", "lineage"):
        if c not in raw.columns:
            raise ValueError(f"missing column: {c}")
    weight = F.col("weight").cast("double") if "weight" in raw.columns else F.lit(1.0)
    checked = F.when(weight == 1, 1.0).otherwise(F.raise_error(F.lit("signature weight must be 1")).cast("double"))
    rows = raw.select(normalize_mutation(F.col("mutation")).alias("mutation"), stripped(F.col("lineage")).alias("lineage"), checked.alias("weight"))
    return rows.filter("mutation <> '' and lineage <> ''").dropDuplicates(["mutation", "lineage"])


def signature_matrix(signatures: DataFrame, targets: DataFrame, use_global: bool = False) -> DataFrame:
    """Long form of the matrix over the target mutations: a semi-join; with use_global, targets without a lineage belong to GLOBAL."""
    wanted = targets.select(normalize_mutation(F.col("mutation")).alias("mutation")).distinct()
    mapped = signatures.join(wanted, "mutation", "left_semi").select("mutation", "lineage", F.lit(1.0).alias("weight"))
    if not use_global:
        return mapped
    rest = wanted.join(signatures, "mutation", "left_anti").select("mutation", F.lit(GLOBAL).alias("lineage"), F.lit(1.0).alias("weight"))
    return mapped.unionByName(rest)


def wide_matrix(matrix: DataFrame, lineages: Sequence[str]) -> DataFrame:
    return matrix.groupBy("mutation").pivot("lineage", list(lineages)).agg(F.first("weight")).na.fill(0.0)


def overlap(matrix: DataFrame) -> DataFrame:
    """Cosine of each pair of lineages, 1 on the diagonal. The self-join is on the mutation and has as many rows as lineages squared for each."""
    a, b = matrix.select("mutation", F.col("lineage").alias("l1"), F.col("weight").alias("w1")), matrix.select("mutation", F.col("lineage").alias("l2"), F.col("weight").alias("w2"))
    norms = matrix.groupBy("lineage").agg((F.sqrt(F.sum(F.col("weight") * F.col("weight"))) + 1e-9).alias("norm"))
    dots = a.join(b, "mutation").groupBy("l1", "l2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    names = small(norms.select(F.col("lineage").alias("l1"), F.col("norm").alias("n1"))).crossJoin(norms.select(F.col("lineage").alias("l2"), F.col("norm").alias("n2")))
    cos = F.coalesce("dot", F.lit(0.0)) / (F.col("n1") * F.col("n2"))
    return names.join(dots, ["l1", "l2"], "left").select("l1", "l2", F.when(F.col("l1") == F.col("l2"), 1.0).otherwise(F.least(F.greatest(cos, F.lit(0.0)), F.lit(1.0))).alias("cosine"))


def near_duplicate_lineages(matrix: DataFrame, above: float = 0.9999) -> DataFrame:
    return overlap(matrix).filter((F.col("l1") < F.col("l2")) & (F.col("cosine") > above))


def rank_and_condition(matrix: DataFrame, tolerance: float = 1e-10) -> tuple[int, float]:
    """Rank and condition number of the matrix, from its Gram matrix: lineages squared numbers on the driver, whatever the mutations."""
    import numpy as np

    a, b = matrix.select("mutation", F.col("lineage").alias("l1"), F.col("weight").alias("w1")), matrix.select("mutation", F.col("lineage").alias("l2"), F.col("weight").alias("w2"))
    rows = a.join(b, "mutation").groupBy("l1", "l2").agg(F.sum(F.col("w1") * F.col("w2")).alias("g")).collect()
    at = {x: i for i, x in enumerate(sorted({r.l1 for r in rows}))}
    gram = np.zeros((len(at), len(at)))
    for r in rows:
        gram[at[r.l1], at[r.l2]] = r.g
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0))[::-1] if len(at) else np.zeros(0)
    # singular values of the matrix are roots of the Gram matrix's, so half of the digits are lost; the tolerance is widened for that
    good = s[s > max(tolerance, 1e-7) * s[0]] if len(s) else s
    return len(good), float(s[0] / s[-1]) if len(s) and s[-1] > 0 else float("inf")


def barcodes(wide: DataFrame, lineage_col: str, wanted: Sequence[str]) -> DataFrame:
    """(lineage, mutation) of the ones in a wide 0/1 table, for the wanted lineages; other values fail when read."""
    names = [c for c in wide.columns if c != lineage_col]
    long = wide.filter(F.col(lineage_col).isin(list(wanted))).withColumns({c: F.col(f"`{c}`").cast("string") for c in names}).unpivot(lineage_col, names, "mutation", "value")
    good = F.when(F.col("value").isin("0", "1", "0.0", "1.0"), F.col("value").cast("double")).otherwise(F.raise_error(F.lit("barcode value is neither 0 nor 1")).cast("double"))
    return long.withColumn("value", good).filter("value = 1").select(F.col(lineage_col).alias("lineage"), "mutation")


def missing_lineages(wide: DataFrame, lineage_col: str, wanted: Sequence[str]) -> DataFrame:
    return wide.sparkSession.createDataFrame([(x,) for x in wanted], "lineage string").join(wide.select(F.col(lineage_col).alias("lineage")), "lineage", "left_anti")


def selected_mutations(matrix: DataFrame, scores: DataFrame | None, mode: str, n: int, manual: Sequence[str] = ()) -> DataFrame:
    """The n first mutations of each lineage by the mode's score; ties by name. scores: mutation, leverage, coverage, mu, pred_af.

    Mode manual: the named mutations in their order, each with its first lineage by name; one that the matrix lacks is an error.
    """
    if mode == "manual":
        names = [(m.strip().upper(), k) for k, m in enumerate(manual, 1)]
        wanted = matrix.sparkSession.createDataFrame(names, "mutation string, rank int")
        first = matrix.groupBy("mutation").agg(F.min(F.when(F.col("weight") == 1, F.col("lineage"))).alias("lineage"), F.lit(True).alias("there"))
        missing = F.raise_error(F.concat(F.lit("not in the signature matrix: "), F.col("mutation"))).cast("string")
        return wanted.join(first, "mutation", "left").select(F.when(F.col("there"), F.coalesce("lineage", F.lit("GLOBAL"))).otherwise(missing).alias("lineage"), "mutation", "rank")
    miss = F.abs(F.col("mu") - F.col("pred_af"))
    order = {"top_leverage": F.desc_nulls_last("leverage"), "highest_coverage": F.desc_nulls_last("coverage"), "best_predicted": miss.asc_nulls_last(), "worst_predicted": miss.desc_nulls_last()}
    if mode not in order:
        raise ValueError(f"unknown selection: {mode}")
    w = Window.partitionBy("lineage").orderBy(order[mode], "mutation")
    return matrix.join(scores, "mutation").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("lineage", "mutation", "rank")


def default_site(coverage: DataFrame) -> DataFrame:
    """The site with the most coverage in all; of equals, the first name."""
    return coverage.groupBy("site_id").agg(F.sum("coverage").alias("total")).orderBy(F.desc("total"), "site_id").limit(1)


def default_dates(theta: DataFrame) -> DataFrame:
    """Per site the date whose composition has the highest entropy (nats); of equals, the first."""
    h = theta.groupBy("site_id", "date").agg(F.sum(F.when(F.col("theta") > 0, -F.col("theta") * F.log("theta")).otherwise(0.0)).alias("entropy"))
    return h.withColumn("r", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc(F.round("entropy", 12)), "date"))).filter("r = 1").drop("r")


def pseudo_counts(priors: DataFrame) -> DataFrame:
    return priors.select("mutation", (F.col("mu") * F.col("kappa")).alias("a"), ((1 - F.col("mu")) * F.col("kappa")).alias("b"))


def density_curve(priors: DataFrame, points: int = 51, eps: float = 1e-9) -> DataFrame:
    """Beta density of each prior on an even grid inside (0, 1), scaled to a maximum of 1."""
    ab = pseudo_counts(priors).select("mutation", F.greatest("a", F.lit(eps)).alias("a"), F.greatest("b", F.lit(eps)).alias("b"))
    grid = ab.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(points)))).withColumn("x", F.col("i") / (points + 1))
    y = F.exp((F.col("a") - 1) * F.log("x") + (F.col("b") - 1) * F.log(1 - F.col("x")) - betaln(F.col("a"), F.col("b")))
    return grid.withColumn("y", y).select("mutation", F.col("i").cast("long").alias("i"), "x", (F.col("y") / F.max("y").over(Window.partitionBy("mutation"))).alias("y"))


def violations(theta: DataFrame, matrix: DataFrame, priors: DataFrame) -> DataFrame:
    """One row: compositions off the simplex, entries that are neither 0 nor 1, priors out of bounds."""
    t = theta.groupBy("site_id", "date").agg((F.abs(F.sum("theta") - 1) > 1e-6).alias("off"), (F.min("theta") < -1e-8).alias("neg")).agg(F.count_if(F.col("off") | F.col("neg")).alias("off_simplex"))
    s = matrix.agg(F.count_if(~F.col("weight").isin(0.0, 1.0)).alias("not_binary"))
    p = priors.agg(F.count_if(~F.col("mu").between(0, 1)).alias("bad_mu"), F.count_if(F.col("kappa") < 0).alias("bad_kappa"))
    return t.crossJoin(s).crossJoin(p)
