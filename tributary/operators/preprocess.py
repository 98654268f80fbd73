"""Cleaning the long count table and the quality statistics over it. Functions that need an overall quantile or the order of all rows run jobs when called; all others are lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.scalars import allele_fraction, allowed_name, canonicalize_strict, detection_limit
from ..sources.scratch import written
from .global_order import exact_quantiles, running_sums

KEY = ("site_id", "date", "sample_id", "mutation")
REQUIRED = (*KEY, "count", "coverage")


def whole_number(c: Column) -> Column:
    """Numbers below 0 and what is no number are 0."""
    return F.greatest(F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def coerced_counts(raw: DataFrame) -> DataFrame:
    """Types and bounds of the raw table, then one row for each key, with counts and coverages added up. Rows without a date go."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    date = F.to_date("date") if dict(raw.dtypes)["date"] in ("date", "timestamp", "timestamp_ntz") else F.when(F.trim("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim("date"), "yyyy-MM-dd"))
    clean = raw.select(F.col("site_id").cast("string").alias("site_id"), date.alias("date"), F.coalesce(F.col("sample_id").cast("string"), F.lit("NA")).alias("sample_id"), canonicalize_strict(F.col("mutation").cast("string")).alias("mutation"), whole_number(F.col("count")).alias("count"), whole_number(F.col("coverage")).alias("coverage"))
    clean = clean.filter(F.col("date").isNotNull()).withColumn("count", F.least("count", "coverage"))
    return clean.groupBy(*KEY).agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))


def with_fractions(snv: DataFrame, least: float = 0.01, min_alt: int = 2) -> DataFrame:
    """Adds af, af_obs, af_censored and lod_threshold; no row is dropped or censored."""
    af = allele_fraction(F.col("count"), F.col("coverage"))
    return snv.select(*REQUIRED, af.alias("af"), af.alias("af_obs"), F.lit(False).alias("af_censored"), detection_limit(F.col("coverage"), least, min_alt).alias("lod_threshold"))


def _quantiles(value: str, **q: float) -> list[Column]:
    """All from one sorted buffer."""
    found = F.percentile(value, F.array(*(F.lit(x) for x in q.values())))
    return [F.get(found, k).alias(name) for k, name in enumerate(q)]


def coverage_summary(snv: DataFrame) -> DataFrame:
    return snv.groupBy("site_id", "date").agg(F.count(F.lit(1)).alias("n_obs"), F.avg("coverage").alias("mean"), *_quantiles("coverage", median=0.5, p05=0.05, p95=0.95), F.min("coverage").alias("min"), F.max("coverage").alias("max"))


def lod_summary(snv: DataFrame) -> DataFrame:
    """Detection limits with the coverage summary of the same site and date, in one aggregation."""
    return snv.groupBy("site_id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("af_censored").alias("n_censored"), F.avg(F.col("af_censored").cast("double")).alias("frac_censored"), F.avg("lod_threshold").alias("mean_lod"),
        F.count(F.lit(1)).alias("n_obs"), F.avg("coverage").alias("mean"), *_quantiles("coverage", median=0.5, p05=0.05, p95=0.95), F.min("coverage").alias("min"), F.max("coverage").alias("max"),
    )


def missingness_summary(snv: DataFrame) -> DataFrame:
    return snv.groupBy("site_id", "date").agg(F.count_distinct("mutation").alias("total_mutations")).withColumns({"missing": F.lit(0).cast("long"), "frac_missing": F.lit(0.0)})


def missingness_matrix(snv: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Long form of the all-zero matrix of sites and mutations: every site with every mutation of the signatures (or of snv).

    The grid is the result, and each side is a distinct list.
    """
    names = (signatures if signatures is not None else snv).select("mutation").filter("mutation is not null").distinct()
    return names.crossJoin(small(snv.select("site_id").distinct())).select("site_id", "mutation", F.lit(0.0).alias("missing"))


def bias_loci(snv: DataFrame, min_coverage: int = 50, left_censor_af: float = 0.01, dropout_quantile: float = 0.10, highcov_quantile: float = 0.70, pos_rate_max: float = 0.01) -> DataFrame:
    """Per mutation: median coverage, its ratio to the overall one, share of positive fractions at high coverage, and two flags."""
    middle, high = exact_quantiles(snv, "coverage", (0.5, highcov_quantile))
    threshold = max(high or 0.0, float(min_coverage))
    each = snv.groupBy("mutation").agg(
        F.median("coverage").alias("median_coverage"),
        F.coalesce(F.avg(F.when(F.col("coverage") >= threshold, (F.col("af") > left_censor_af).cast("double"))), F.lit(0.0)).alias("af_pos_rate_highcov"),
    )
    each = written(each, "loci")
    cut = exact_quantiles(each.filter("median_coverage <> 0"), "median_coverage", (dropout_quantile,))[0] or 0.0
    values = {"global_median_coverage": middle, "highcov_threshold": threshold, "dropout_threshold": cut}
    return each.withColumns({c: F.lit(v).cast("double") for c, v in values.items()}).select(
        "mutation", "median_coverage", (F.col("median_coverage") / F.greatest("global_median_coverage", F.lit(1.0))).alias("coverage_ratio_to_global"), "af_pos_rate_highcov",
        (F.col("median_coverage") <= F.col("dropout_threshold")).alias("flag_dropout"), (F.col("af_pos_rate_highcov") <= pos_rate_max).alias("flag_ref_bias"), "dropout_threshold", "highcov_threshold",
        F.lit(pos_rate_max).alias("ref_bias_threshold"), "global_median_coverage",
    )


def coverage_metrics(snv: DataFrame) -> DataFrame:
    return snv.groupBy("site_id", "date").agg(F.count(F.lit(1)).alias("n_obs"), F.avg("coverage").alias("mean"), *_quantiles("coverage", median=0.5, p10=0.1, p90=0.9))


def mutation_prevalence(snv: DataFrame) -> DataFrame:
    daily = snv.groupBy("mutation", "date").agg(F.sum("count").alias("y")).groupBy("mutation").agg(F.count(F.lit(1)).alias("n_dates_total"), F.count_if(F.col("y") > 0).alias("n_dates_nonzero"))
    each = snv.groupBy("mutation").agg(F.avg((F.col("af") > 0).cast("double")).alias("prevalence_rows"), allele_fraction(F.sum("count"), F.sum("coverage")).alias("prevalence_weighted"), F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("total_count"), F.sum("coverage").alias("total_coverage"), F.avg("coverage").alias("mean_coverage"), F.median("coverage").alias("median_coverage"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return each.join(daily, "mutation")


def mutation_entropy(snv: DataFrame) -> DataFrame:
    """Spread of a mutation's daily fractions over its dates: entropy, its exponent, Gini coefficient and peak. Dates per mutation are few."""
    day = snv.groupBy("mutation", "date").agg(allele_fraction(F.sum("count"), F.sum("coverage")).alias("m"))
    share = day.withColumn("total", F.sum("m").over(Window.partitionBy("mutation"))).withColumn("p", F.when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(0.0))
    share = share.withColumn("i", F.row_number().over(Window.partitionBy("mutation").orderBy("p", "date")))
    g = share.groupBy("mutation").agg(
        F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log(F.col("p") + 1e-12)).otherwise(0.0)).alias("h"), F.count_if(F.col("p") > 0).alias("nonzero"),
        F.sum(F.col("i") * F.col("p")).alias("ip"), F.max(F.struct("m", (-F.datediff("date", F.lit("1970-01-01"))).alias("d"), "date")).alias("top"), F.max("p").alias("peak"),
    )
    some = F.col("total") > 0
    return g.select("mutation", F.when(some, F.col("h")).otherwise(0.0).alias("entropy"), F.when(some & (F.col("nonzero") > 1), F.col("h") / F.log("nonzero")).when(some, F.lit(0.0)).alias("entropy_norm"), F.when(some, F.exp("h")).otherwise(0.0).alias("effective_dates"), F.when(some, 2 * F.col("ip") / F.col("n") - (F.col("n") + 1) / F.col("n")).alias("gini"), F.when(some, F.col("top.date")).alias("peak_date"), F.when(some, F.col("peak")).alias("peak_fraction"))


def mutation_variance(snv: DataFrame) -> DataFrame:
    w = F.sum("coverage")
    mean = F.sum(F.col("af") * F.col("coverage")) / w
    square = F.sum(F.col("af") * F.col("af") * F.col("coverage")) / w
    q = F.percentile("af", F.array(F.lit(0.25), F.lit(0.75)))
    return snv.groupBy("mutation").agg(F.coalesce(F.var_samp("af"), F.lit(0.0)).alias("var_af"), F.avg("af").alias("mean_af"), F.median("af").alias("median_af"), (F.get(q, 1) - F.get(q, 0)).alias("iqr_af"), F.when(w > 0, mean).alias("wmean_af"), F.when(w > 0, F.greatest(square - mean * mean, F.lit(0.0))).alias("wvar_af"), F.count(F.lit(1)).alias("n_obs"), w.alias("total_coverage"))


def mutation_missingness(snv: DataFrame, min_coverage: int = 50) -> DataFrame:
    """Share of the grid of sites and dates without enough coverage; the grid is counted, never built."""
    grid = snv.agg(F.count_distinct("site_id").alias("n_sites"), F.count_distinct("date").alias("n_dates"))
    cells = snv.filter(F.col("coverage") >= min_coverage).groupBy("mutation").agg(F.count_distinct("site_id", "date").alias("present"))
    all_names = snv.select("mutation").distinct()
    n = F.col("n_sites") * F.col("n_dates")
    return all_names.join(cells, "mutation", "left").crossJoin(F.broadcast(grid)).select("mutation", F.coalesce("present", F.lit(0)).alias("present_count"), (F.coalesce("present", F.lit(0)) / n).alias("present_rate"), (1 - F.coalesce("present", F.lit(0)) / n).alias("missingness_rate"), "n_sites", "n_dates")


def alt_ref_correlation(snv: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of alternative and reference counts. Ranks come from counted distinct values, not from sorting rows."""
    both = snv.select(F.col("count").cast("double").alias("a"), (F.col("coverage") - F.col("count")).cast("double").alias("r")).groupBy("a", "r").agg(F.count(F.lit(1)).alias("n"))
    pairs = both
    for c in ("a", "r"):
        ranks = average_ranks(both, c, "n").withColumnRenamed("rank", f"rank_{c}")
        pairs = pairs.join(ranks, c)
    return pairs.agg(weighted_corr("a", "r", "n").alias("pearson_r"), weighted_corr("rank_a", "rank_r", "n").alias("spearman_r"), F.sum("n").alias("n"))


def average_ranks(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, rank) of distinct values that stand for `weight` rows: the average rank of ties."""
    each = running_sums(df.groupBy(value).agg(F.sum(weight).alias("w")), [value], "w")
    return each.select(value, (F.col("upto") - F.col("w") + (F.col("w") + 1) / 2).alias("rank"))


def weighted_corr(x: str, y: str, w: str) -> Column:
    n, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    cov = F.sum(F.col(w) * F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(w) * F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(w) * F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def overdispersion_moments(snv: DataFrame) -> DataFrame:
    """Per mutation with covered rows: concentration and overdispersion of a Beta-Binomial by moments, in closed form."""
    p, m, n = F.col("count") / F.col("coverage"), F.lit(1.0) / F.col("coverage"), F.col("coverage")
    g = snv.filter("coverage > 0").groupBy("mutation").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("count") / F.sum("coverage")).alias("p_hat"), F.avg(n).alias("n_bar"), F.var_samp("count").alias("var_y"), F.var_samp(p).alias("s2"), F.avg(m).alias("inv_n"))
    v = F.col("p_hat") * (1 - F.col("p_hat"))
    g = g.withColumns({"theory_max": v, "theory_min": v * F.col("inv_n")})
    status = F.when((F.col("n_rows") < 2) | F.col("s2").isNull(), "insufficient").when(v <= 0, "degenerate").when(F.col("s2") >= F.col("theory_max") - 1e-12, "at_upper").when(F.col("s2") <= F.col("theory_min") + 1e-12, "at_lower").otherwise("ok")
    g = g.withColumn("status", status)
    ratio = F.col("s2") / v
    kappa = F.when(F.col("status") == "at_upper", 0.0).when(F.col("status") == "at_lower", 1e12).when(F.col("status") == "ok", (1 - ratio) / (ratio - F.col("inv_n")))
    g = g.withColumn("kappa", kappa)
    return g.withColumns({"rho": 1 / (1 + F.col("kappa")), "alpha": F.col("p_hat") * F.col("kappa"), "beta": (1 - F.col("p_hat")) * F.col("kappa")})


def site_summary(snv: DataFrame) -> DataFrame:
    return snv.groupBy("site_id").agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("date").alias("n_dates"), F.avg("coverage").alias("mean_coverage"), F.avg(F.col("af_censored").cast("double")).alias("frac_censored"))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """struct<p, lo, hi>: Wilson's interval; null for no trials. Squares of trials are doubles, as whole ones overflow beyond 3e9 (1.5e9 with the factor 4)."""
    trials = trials.cast("double")
    p, z2 = successes / trials, z * z
    centre = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    return F.when(trials > 0, F.struct(p.alias("p"), F.greatest(centre - half, F.lit(0.0)).alias("lo"), F.least(centre + half, F.lit(1.0)).alias("hi")))


def global_fraction(snv: DataFrame, highcov_quantile: float = 0.70, left_censor_af: float = 0.01) -> DataFrame:
    """Overall fraction with Wilson's interval, concentration by moments, and rates at high coverage: one row."""
    high = F.col("coverage") >= F.lit(exact_quantiles(snv, "coverage", (highcov_quantile,))[0]).cast("double")
    g = snv.agg(F.sum("count").alias("y"), F.sum("coverage").alias("n"), F.avg("coverage").alias("n_bar"), F.var_samp("count").alias("var_y"), F.avg(F.when(high, (F.col("af") > left_censor_af).cast("double"))).alias("highcov_pos_rate"), F.avg(F.when(high, (F.col("count") == 0).cast("double"))).alias("highcov_zero_rate"))
    g = g.withColumn("w", wilson(F.col("y"), F.col("n")))
    p = F.col("w.p")
    kappa = F.greatest((F.col("n_bar") - 1) / F.greatest(F.col("var_y") / (F.col("n_bar") * p * (1 - p)) - 1, F.lit(1e-12)) - 1, F.lit(0.0))
    return g.select("y", "n", p.alias("p_hat"), F.col("w.lo").alias("ci_lo"), F.col("w.hi").alias("ci_hi"), kappa.alias("kappa_mom"), "highcov_pos_rate", "highcov_zero_rate")


def coverage_by_mutation(snv: DataFrame) -> DataFrame:
    v = F.coalesce(F.var_samp("coverage"), F.lit(0.0))
    return snv.groupBy("mutation").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean"), F.median("coverage").alias("median"), v.alias("var"), F.when(F.avg("coverage") > 0, F.sqrt(v) / F.avg("coverage")).alias("cv"), *_quantiles("coverage", q05=0.05, q95=0.95))


def coverage_ecdf(snv: DataFrame) -> DataFrame:
    """Per site and distinct coverage: the share of rows at most that. Counts of values are windowed, not rows."""
    each = snv.groupBy("site_id", "coverage").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("site_id")
    return each.select("site_id", "coverage", (F.sum("n").over(w.orderBy("coverage")) / F.sum("n").over(w)).alias("ecdf"))


def coverage_inequality(snv: DataFrame) -> DataFrame:
    """Per site: mean, variance, median, q10, q90 and the Gini coefficient of coverage, from counted values."""
    each = snv.groupBy("site_id", "coverage").agg(F.count(F.lit(1)).cast("double").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("site_id").orderBy("coverage"))
    # the ranks of n equal values add up to n * (first + last) / 2
    ranked = each.withColumn("rank_sum", F.col("n") * ((upto - F.col("n") + 1) + upto) / 2)
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("coverage"))
    g = ranked.groupBy("site_id").agg(F.when(s > 0, 2 * F.sum(F.col("rank_sum") * F.col("coverage")) / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))
    stats = snv.groupBy("site_id").agg(F.avg("coverage").alias("mean"), F.var_samp("coverage").alias("var"), *_quantiles("coverage", median=0.5, q10=0.1, q90=0.9))
    return stats.join(g, "site_id")


def coverage_histogram(snv: DataFrame, bins: int = 34) -> DataFrame:
    """Bins equal in the logarithm between the 1st and 99.5th percentile of positive coverage; the last is closed."""
    positive = snv.filter("coverage > 0").groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = (F.log10(F.lit(q).cast("double")) for q in exact_quantiles(snv.filter("coverage > 0"), "coverage", (0.01, 0.995)))
    x = F.log10("coverage")
    placed = positive.filter((x >= lo) & (x <= hi)).withColumn("bin", F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long"))
    return placed.groupBy("bin").agg(F.sum("n").alias("n"))


def coverage_density(snv: DataFrame, points: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density of log10 coverage on an even grid, with Scott's width. Sums run over distinct coverages, exploded by the grid."""
    x = F.log10("coverage")
    each = snv.filter("coverage > 0").groupBy(*by, "coverage").agg(F.count(F.lit(1)).alias("n")).withColumn("x", x)
    g = each.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sq"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = g.withColumn("h", F.sqrt((F.col("sq") - F.col("total") * F.col("mean") * F.col("mean")) / (F.col("total") - 1)) * F.pow("total", F.lit(-0.2)))
    joined = each.join(F.broadcast(g), list(by)) if by else each.crossJoin(F.broadcast(g))
    grid = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    z = (F.col("at") - F.col("x")) / F.col("h")
    return grid.groupBy(*by, "i").agg(F.first("at").alias("log10_coverage"), (F.sum(F.col("n") * F.exp(-z * z / 2)) / F.first(F.col("total") * F.col("h")) / 2.5066282746310002).alias("density")).withColumn("i", F.col("i").cast("long"))


def lineage_presence(snv: DataFrame, signatures: DataFrame, k: int = 3) -> DataFrame:
    """The k lineages of each site with the most rows above zero; ties by name."""
    hits = snv.filter("af_obs > 0").join(signatures.select("mutation", "lineage").distinct(), "mutation").groupBy("site_id", "lineage").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("site_id").orderBy(F.desc("n"), "lineage")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def daily_fraction(snv: DataFrame) -> DataFrame:
    """(site_id, date, mutation, waf, coverage): coverage-weighted fraction."""
    return snv.groupBy("site_id", "date", "mutation").agg((F.sum(F.col("af") * F.col("coverage")) / F.greatest(F.sum("coverage"), F.lit(1))).alias("waf"), F.sum("coverage").alias("coverage"))


def signature_presence(snv: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per site, date and lineage: share of the lineage's signature weight whose mutations were seen that day; 0 on days without a hit."""
    total = signatures.groupBy("lineage").agg(F.sum("weight").alias("total"))
    seen = daily_fraction(snv).filter("waf > 0").join(signatures, "mutation").groupBy("site_id", "date", "lineage").agg(F.sum("weight").alias("hit"))
    days = snv.select("site_id", "date").distinct().crossJoin(F.broadcast(total))
    return days.join(seen, ["site_id", "date", "lineage"], "left").select("site_id", "date", "lineage", (F.coalesce("hit", F.lit(0.0)) / F.col("total")).alias("presence"))


def lineage_index(snv: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per site, date and lineage: signature-weighted mean of the daily fractions, for lineages above zero somewhere at the site."""
    each = daily_fraction(snv).join(signatures, "mutation").groupBy("site_id", "date", "lineage").agg((F.sum(F.col("weight") * F.col("waf")) / F.greatest(F.sum("weight"), F.lit(1.0))).alias("index"))
    return each.withColumn("top", F.max("index").over(Window.partitionBy("site_id", "lineage"))).filter("top > 0").drop("top")


def most_variable(snv: DataFrame, k: int) -> DataFrame:
    """The k mutations with the highest variance, then mean, then name, of the fraction."""
    return snv.groupBy("mutation").agg(F.coalesce(F.var_samp("af"), F.lit(0.0)).alias("var_af"), F.avg("af").alias("mean_af")).orderBy(F.desc("var_af"), F.desc("mean_af"), "mutation").limit(k)


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 12345) -> DataFrame:
    """At most n rows, the same ones in every run: those with the smallest seeded digests of their key."""
    return df.orderBy(seeded_digest(key, seed), *key).limit(n)


def seeded_digest(key: Sequence[str], seed: int) -> Column:
    """A digest of seed and key that any engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)).cast("binary"))


def schema_validation(snv: DataFrame, signatures: DataFrame) -> DataFrame:
    """(table, check, passed, details), as facts about the rows; types are those that Spark has."""

    def facts(df: DataFrame, table: str, columns: Sequence[str], counted: dict[str, Column], unique: Sequence[str]) -> DataFrame:
        spark = df.sparkSession
        fixed = [(table, f"has_column:{c}", c in df.columns, "") for c in columns]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counted.items()))
        dup = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        both = one.crossJoin(dup)
        entries = [F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.concat(F.lit("violations="), F.col(n)).alias("details")) for n in counted]
        entries += [F.struct(F.lit("key_unique").alias("check"), (F.col("duplicates") == 0).alias("passed"), F.concat(F.lit("duplicates="), F.col("duplicates")).alias("details")), F.struct(F.lit("non_empty_table").alias("check"), (F.col("rows") > 0).alias("passed"), F.concat(F.lit("rows="), F.col("rows")).alias("details"))]
        return spark.createDataFrame(fixed, "table string, check string, passed boolean, details string").unionByName(both.select(F.lit(table).alias("table"), F.inline(F.array(*entries))))

    a = facts(snv, "snv", REQUIRED, {"count_nonnegative": F.col("count") < 0, "coverage_nonnegative": F.col("coverage") < 0, "count_le_coverage": F.col("count") > F.col("coverage"), "mutation_char_set_ok": ~allowed_name(F.coalesce("mutation", F.lit(""))), "date_not_null": F.col("date").isNull()}, KEY)
    b = facts(signatures, "signatures", ("mutation", "lineage", "weight"), {"weight_equals_1": F.col("weight") != 1}, ("mutation", "lineage"))
    return a.unionByName(b)
