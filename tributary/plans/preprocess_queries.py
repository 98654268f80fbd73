"""Queries over the cleaned count table, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..functions import scalars as S
from ..operators import preprocess as P
from ..registry import query

_BY = "SELECT site_id, date, "
_COV = "count(*) AS n_obs, avg(coverage) AS mean, median(coverage) AS median, quantile_cont(coverage, 0.05) AS p05, quantile_cont(coverage, 0.95) AS p95, min(coverage) AS min, max(coverage) AS max"

query("IO_01_coerced_counts", sql("SELECT * FROM summed"), longs="count coverage")(lambda s, d: P.coerced_counts(A.snv_raw(s, d)))
query("PRE_01_coverage_summary", sql(f"{_BY}{_COV} FROM snv GROUP BY ALL"), "mean median p05 p95", "n_obs min max")(lambda s, d: P.coverage_summary(A.snv(s, d)))
query("PRE_02_lod_summary", sql(f"{_BY}count(*) AS n_rows, 0 AS n_censored, 0.0 AS frac_censored, avg(lod_threshold) AS mean_lod, {_COV} FROM snv GROUP BY site_id, date"), "frac_censored mean_lod mean median p05 p95", "n_rows n_censored n_obs min max")(lambda s, d: P.lod_summary(A.snv(s, d)))
query("PRE_03_missingness_summary", sql(f"{_BY}count(DISTINCT mutation) AS total_mutations, 0 AS missing, 0.0 AS frac_missing FROM snv GROUP BY site_id, date"), "frac_missing", "total_mutations missing")(lambda s, d: P.missingness_summary(A.snv(s, d)))
query("PRE_04_missingness_matrix", sql("SELECT site_id, mutation, 0.0 AS missing FROM (SELECT DISTINCT site_id FROM snv), (SELECT DISTINCT mutation FROM signatures)"), "missing")(lambda s, d: P.missingness_matrix(A.snv(s, d), A.signatures(s, d)))
query(
    "PRE_05_bias_loci",
    sql(""", o AS (SELECT median(coverage) AS g, greatest(quantile_cont(coverage, 0.7), 50.0) AS h FROM snv),
 m AS (SELECT mutation, median(coverage) AS mc, coalesce(avg(CASE WHEN coverage>=h THEN cast(af>0.01 AS integer) END), 0) AS r FROM snv, o GROUP BY mutation),
 c AS (SELECT coalesce(quantile_cont(mc, 0.1) FILTER (WHERE mc<>0), 0) AS cut FROM m)
 SELECT mutation, mc AS median_coverage, mc/greatest(g,1) AS coverage_ratio_to_global, r AS af_pos_rate_highcov, mc<=cut AS flag_dropout, r<=0.01 AS flag_ref_bias, cut AS dropout_threshold, h AS highcov_threshold, 0.01 AS ref_bias_threshold, g AS global_median_coverage FROM m, o, c"""),
    "median_coverage coverage_ratio_to_global af_pos_rate_highcov dropout_threshold highcov_threshold ref_bias_threshold global_median_coverage",
)(lambda s, d: P.bias_loci(A.snv(s, d)))
query("PRE_06_coverage_metrics", sql(f"{_BY}count(*) AS n_obs, avg(coverage) AS mean, median(coverage) AS median, quantile_cont(coverage, 0.1) AS p10, quantile_cont(coverage, 0.9) AS p90 FROM snv GROUP BY ALL"), "mean median p10 p90", "n_obs")(lambda s, d: P.coverage_metrics(A.snv(s, d)))
query(
    "PRE_07_mutation_prevalence",
    sql(""", d AS (SELECT mutation, count(*) AS n_dates_total, count(*) FILTER (WHERE y>0) AS n_dates_nonzero FROM (SELECT mutation, date, sum(count) AS y FROM snv GROUP BY ALL) GROUP BY mutation)
 SELECT mutation, avg(cast(af>0 AS integer)) AS prevalence_rows, CASE WHEN sum(coverage)>0 THEN sum(count)/sum(coverage) ELSE 0 END AS prevalence_weighted, count(*) AS n_rows, sum(count) AS total_count, sum(coverage) AS total_coverage, avg(coverage) AS mean_coverage, median(coverage) AS median_coverage, min(date) AS first_date, max(date) AS last_date, any_value(n_dates_total) AS n_dates_total, any_value(n_dates_nonzero) AS n_dates_nonzero FROM snv JOIN d USING (mutation) GROUP BY mutation"""),
    "prevalence_rows prevalence_weighted mean_coverage median_coverage", "n_rows total_count total_coverage n_dates_total n_dates_nonzero",
)(lambda s, d: P.mutation_prevalence(A.snv(s, d)))
query(
    "PRE_08_mutation_entropy",
    sql(""", m AS (SELECT mutation, date, CASE WHEN sum(coverage)>0 THEN sum(count)/sum(coverage) ELSE 0 END AS m FROM snv GROUP BY ALL),
 p AS (SELECT *, CASE WHEN t>0 THEN m/t ELSE 0 END AS p FROM (SELECT *, sum(m) OVER (PARTITION BY mutation) AS t FROM m)),
 i AS (SELECT *, row_number() OVER (PARTITION BY mutation ORDER BY p, date) AS i, row_number() OVER (PARTITION BY mutation ORDER BY m DESC, date) AS top FROM p),
 g AS (SELECT mutation, count(*) AS n, max(t) AS t, sum(CASE WHEN p>0 THEN -p*ln(p+1e-12) ELSE 0 END) AS h, count(*) FILTER (WHERE p>0) AS k, sum(i*p) AS ip, max(date) FILTER (WHERE top=1) AS pd, max(p) AS pk FROM i GROUP BY mutation)
 SELECT mutation, CASE WHEN t>0 THEN h ELSE 0 END AS entropy, CASE WHEN t>0 AND k>1 THEN h/ln(k) WHEN t>0 THEN 0 END AS entropy_norm, CASE WHEN t>0 THEN exp(h) ELSE 0 END AS effective_dates, CASE WHEN t>0 THEN 2*ip/n-(n+1)/n END AS gini, CASE WHEN t>0 THEN pd END AS peak_date, CASE WHEN t>0 THEN pk END AS peak_fraction FROM g"""),
    "entropy entropy_norm effective_dates gini peak_fraction",
)(lambda s, d: P.mutation_entropy(A.snv(s, d)))
query(
    "PRE_09_mutation_variance",
    sql("""SELECT mutation, coalesce(var_samp(af),0) AS var_af, avg(af) AS mean_af, median(af) AS median_af, quantile_cont(af,0.75)-quantile_cont(af,0.25) AS iqr_af, sum(af*coverage)/sum(coverage) AS wmean_af,
 greatest(sum(af*af*coverage)/sum(coverage)-(sum(af*coverage)/sum(coverage))*(sum(af*coverage)/sum(coverage)),0) AS wvar_af, count(*) AS n_obs, sum(coverage) AS total_coverage FROM snv GROUP BY mutation"""),
    "var_af mean_af median_af iqr_af wmean_af wvar_af", "n_obs total_coverage",
)(lambda s, d: P.mutation_variance(A.snv(s, d)))
query(
    "PRE_10_mutation_missingness",
    sql(""", g AS (SELECT count(DISTINCT site_id) AS n_sites, count(DISTINCT date) AS n_dates FROM snv), c AS (SELECT mutation, count(*) AS k FROM (SELECT DISTINCT mutation, site_id, date FROM snv WHERE coverage>=50) GROUP BY mutation)
 SELECT mutation, coalesce(k,0) AS present_count, coalesce(k,0)/(n_sites*n_dates) AS present_rate, 1-coalesce(k,0)/(n_sites*n_dates) AS missingness_rate, n_sites, n_dates FROM (SELECT DISTINCT mutation FROM snv) LEFT JOIN c USING (mutation), g"""),
    "present_rate missingness_rate", "present_count n_sites n_dates",
)(lambda s, d: P.mutation_missingness(A.snv(s, d)))
query(
    "PRE_11_alt_ref_correlation",
    sql(""", v AS (SELECT cast(count AS double) AS a, cast(coverage-count AS double) AS r FROM snv), k AS (SELECT a, r, rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2 AS ra, rank() OVER (ORDER BY r)+(count(*) OVER (PARTITION BY r)-1)/2 AS rr FROM v)
 SELECT corr(a,r) AS pearson_r, corr(ra,rr) AS spearman_r, count(*) AS n FROM k"""),
    "pearson_r spearman_r", "n",
)(lambda s, d: P.alt_ref_correlation(A.snv(s, d)))
query(
    "PRE_12_overdispersion_moments",
    sql(""", g AS (SELECT mutation, count(*) AS n_rows, sum(count)/sum(coverage) AS p_hat, avg(coverage) AS n_bar, var_samp(count) AS var_y, var_samp(count/coverage) AS s2, avg(1/coverage) AS inv_n FROM snv WHERE coverage>0 GROUP BY mutation),
 t AS (SELECT *, p_hat*(1-p_hat) AS theory_max, p_hat*(1-p_hat)*inv_n AS theory_min FROM g),
 u AS (SELECT *, CASE WHEN n_rows<2 OR s2 IS NULL THEN 'insufficient' WHEN theory_max<=0 THEN 'degenerate' WHEN s2>=theory_max-1e-12 THEN 'at_upper' WHEN s2<=theory_min+1e-12 THEN 'at_lower' ELSE 'ok' END AS status FROM t),
 k AS (SELECT *, CASE status WHEN 'at_upper' THEN 0 WHEN 'at_lower' THEN 1e12 WHEN 'ok' THEN (1-s2/theory_max)/(s2/theory_max-inv_n) END AS kappa FROM u)
 SELECT *, 1/(1+kappa) AS rho, p_hat*kappa AS alpha, (1-p_hat)*kappa AS beta FROM k"""),
    "p_hat n_bar var_y s2 inv_n theory_max theory_min kappa rho alpha beta", "n_rows",
)(lambda s, d: P.overdispersion_moments(A.snv(s, d)))
query(
    "PRE_13_schema_validation",
    sql(""", a AS (SELECT count(*) AS n, count(*) FILTER (WHERE count<0) AS c0, count(*) FILTER (WHERE coverage<0) AS c1, count(*) FILTER (WHERE count>coverage) AS c2, count(*) FILTER (WHERE NOT regexp_full_match(coalesce(mutation,''),'[A-Z0-9:_\\-]*')) AS c3, count(*) FILTER (WHERE date IS NULL) AS c4, count(*)-count(DISTINCT (site_id,date,sample_id,mutation)) AS dup FROM snv),
 b AS (SELECT count(*) AS n, count(*) FILTER (WHERE weight<>1) AS c0, count(*)-count(DISTINCT (mutation,lineage)) AS dup FROM signatures)
 SELECT 'snv' AS "table", 'has_column:'||c AS "check", true AS passed, '' AS details FROM (SELECT unnest(['site_id','date','sample_id','mutation','count','coverage']) AS c)
 UNION ALL SELECT 'snv', unnest(['count_nonnegative','coverage_nonnegative','count_le_coverage','mutation_char_set_ok','date_not_null']), unnest([c0=0,c1=0,c2=0,c3=0,c4=0]), 'violations='||unnest([c0,c1,c2,c3,c4]) FROM a
 UNION ALL SELECT 'snv', unnest(['key_unique','non_empty_table']), unnest([dup=0,n>0]), unnest(['duplicates='||dup,'rows='||n]) FROM a
 UNION ALL SELECT 'signatures', 'has_column:'||c, true, '' FROM (SELECT unnest(['mutation','lineage','weight']) AS c)
 UNION ALL SELECT 'signatures', unnest(['weight_equals_1','key_unique','non_empty_table']), unnest([c0=0,dup=0,n>0]), unnest(['violations='||c0,'duplicates='||dup,'rows='||n]) FROM b""").replace("\\\\-", "\\-"),
)(lambda s, d: P.schema_validation(A.snv(s, d), A.signatures(s, d)))
query("PRE_14_feature_store", sql("SELECT site_id, date, sample_id, mutation, count, coverage, af, af AS af_obs, false AS af_censored, lod_threshold FROM snv"), "af af_obs lod_threshold", "count coverage")(lambda s, d: A.snv(s, d))
query("PRE_15_site_summary", sql("SELECT site_id, count(DISTINCT sample_id) AS n_samples, count(DISTINCT date) AS n_dates, avg(coverage) AS mean_coverage, 0.0 AS frac_censored FROM snv GROUP BY site_id"), "mean_coverage frac_censored", "n_samples n_dates")(lambda s, d: P.site_summary(A.snv(s, d)))
_Z = 1.959963984540054
query(
    "PRE_16_18_global_fraction",
    sql(f""", h AS (SELECT quantile_cont(coverage,0.7) AS cut FROM snv), g AS (SELECT sum(count) AS y, sum(coverage) AS n, avg(coverage) AS nb, var_samp(count) AS vy, avg(CASE WHEN coverage>=cut THEN cast(af>0.01 AS integer) END) AS hp, avg(CASE WHEN coverage>=cut THEN cast(count=0 AS integer) END) AS hz, sum(count)/sum(coverage) AS p FROM snv, h)
 SELECT y, n, p AS p_hat, (p+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n)-{_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4.0*n*n))/(1+{_Z}*{_Z}/n) AS ci_lo, (p+{_Z}*{_Z}/(2*n))/(1+{_Z}*{_Z}/n)+{_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4.0*n*n))/(1+{_Z}*{_Z}/n) AS ci_hi,
 greatest((nb-1)/greatest(vy/(nb*p*(1-p))-1,1e-12)-1,0) AS kappa_mom, hp AS highcov_pos_rate, hz AS highcov_zero_rate FROM g"""),
    "p_hat ci_lo ci_hi kappa_mom highcov_pos_rate highcov_zero_rate", "y n",
)(lambda s, d: P.global_fraction(A.snv(s, d)))
query("PRE_19_coverage_by_mutation", sql("SELECT mutation, count(*) AS n, avg(coverage) AS mean, median(coverage) AS median, coalesce(var_samp(coverage),0) AS var, sqrt(coalesce(var_samp(coverage),0))/avg(coverage) AS cv, quantile_cont(coverage,0.05) AS q05, quantile_cont(coverage,0.95) AS q95 FROM snv GROUP BY mutation"), "mean median var cv q05 q95", "n")(lambda s, d: P.coverage_by_mutation(A.snv(s, d)))
query("PRE_20_coverage_ecdf", sql("SELECT DISTINCT site_id, coverage, cume_dist() OVER (PARTITION BY site_id ORDER BY coverage) AS ecdf FROM snv"), "ecdf", "coverage")(lambda s, d: P.coverage_ecdf(A.snv(s, d)))
query(
    "PRE_20_coverage_inequality",
    sql(""", r AS (SELECT site_id, coverage, row_number() OVER (PARTITION BY site_id ORDER BY coverage) AS i, count(*) OVER (PARTITION BY site_id) AS n FROM snv)
 SELECT site_id, avg(coverage) AS mean, var_samp(coverage) AS var, median(coverage) AS median, quantile_cont(coverage,0.1) AS q10, quantile_cont(coverage,0.9) AS q90, 2*sum(i*coverage)/(max(n)*sum(coverage))-(max(n)+1)/max(n) AS gini FROM r GROUP BY site_id"""),
    "mean var median q10 q90 gini",
)(lambda s, d: P.coverage_inequality(A.snv(s, d)))
query(
    "PRE_21_coverage_histogram",
    sql(""", e AS (SELECT log10(quantile_cont(coverage,0.01)) AS lo, log10(quantile_cont(coverage,0.995)) AS hi FROM snv WHERE coverage>0)
 SELECT least(floor((log10(coverage)-lo)/(hi-lo)*34),33) AS bin, count(*) AS n FROM snv, e WHERE coverage>0 AND log10(coverage)>=lo AND log10(coverage)<=hi GROUP BY 1"""),
    longs="bin n",
)(lambda s, d: P.coverage_histogram(A.snv(s, d)))
query(
    "PRE_22_coverage_density",
    sql(""", x AS (SELECT log10(coverage) AS x FROM snv WHERE coverage>0), g AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x)*power(count(*),-0.2) AS h FROM x), t AS (SELECT unnest(range(64)) AS i)
 SELECT i, lo+i*(hi-lo)/63 AS log10_coverage, sum(exp(-power((lo+i*(hi-lo)/63-x)/h,2)/2))/any_value(n*h)/2.5066282746310002 AS density FROM x, g, t GROUP BY i, lo, hi"""),
    "log10_coverage density", "i",
)(lambda s, d: P.coverage_density(A.snv(s, d)))
query("PRE_23_lineage_presence", sql("SELECT * FROM (SELECT site_id, lineage, count(*) AS n, row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, lineage) AS rank FROM snv JOIN signatures USING (mutation) WHERE af>0 GROUP BY site_id, lineage) WHERE rank<=3"), longs="n rank")(lambda s, d: P.lineage_presence(A.snv(s, d), A.signatures(s, d)))
_DAY = ", w AS (SELECT site_id, date, mutation, sum(af*coverage)/greatest(sum(coverage),1) AS waf FROM snv GROUP BY ALL)"
query(
    "PRE_24_signature_presence",
    sql(_DAY + """, t AS (SELECT lineage, sum(weight) AS total FROM signatures GROUP BY 1), s AS (SELECT site_id, date, lineage, sum(weight) AS hit FROM w JOIN signatures USING (mutation) WHERE waf>0 GROUP BY ALL)
 SELECT site_id, date, lineage, coalesce(hit,0)/total AS presence FROM (SELECT DISTINCT site_id, date FROM snv), t LEFT JOIN s USING (site_id, date, lineage)""".replace("FROM (SELECT DISTINCT site_id, date FROM snv), t LEFT JOIN", "FROM (SELECT * FROM (SELECT DISTINCT site_id, date FROM snv), t) LEFT JOIN")),
    "presence",
)(lambda s, d: P.signature_presence(A.snv(s, d), A.signatures(s, d)))
query("PRE_25_lineage_index", sql(_DAY + ', e AS (SELECT site_id, date, lineage, sum(weight*waf)/greatest(sum(weight),1) AS "index" FROM w JOIN signatures USING (mutation) GROUP BY ALL) SELECT * EXCLUDE (top) FROM (SELECT *, max("index") OVER (PARTITION BY site_id, lineage) AS top FROM e) WHERE top>0'), '"index"')(lambda s, d: P.lineage_index(A.snv(s, d), A.signatures(s, d)))
query("PRE_26_most_variable", sql("SELECT mutation, coalesce(var_samp(af),0) AS var_af, avg(af) AS mean_af FROM snv GROUP BY mutation ORDER BY 2 DESC, 3 DESC, 1 LIMIT 12"), "var_af mean_af")(lambda s, d: P.most_variable(A.snv(s, d), 12))
query("PRE_27_hash_sample", sql("SELECT site_id, date, sample_id, mutation FROM snv ORDER BY md5(concat_ws('|','12345',site_id,cast(date AS varchar),sample_id,mutation)), site_id, date, sample_id, mutation LIMIT 500"))(lambda s, d: P.hash_sample(A.snv(s, d), P.KEY, 500).select(*P.KEY))

_NAMES = "SELECT p_name AS raw, ' '||lower(p_name)||'->'||p_brand||'* ' AS odd FROM part"
query(
    "SC_01_09_names",
    rf"""SELECT odd, regexp_replace(replace(replace(upper(trim(odd)),' ',''),'->',''),'[^A-Z0-9:_\-]','','g') AS strict, upper(trim(odd)) AS normal, regexp_replace(lower(regexp_replace(odd,'\W+','_','g')),'^_+|_+$','','g') AS safe, regexp_full_match(raw,'[A-Z0-9:_\-]*') AS allowed, regexp_replace(odd,'[^\p{{L}}\p{{N}}\-_.+]','','g') AS file,
 CASE lower(trim(raw)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, regexp_matches(raw,'^(?:[A-M])') AS starts FROM ({_NAMES})""",
)(lambda s, d: A.table(s, d, "part").select(F.col("p_name").alias("raw"), F.concat(F.lit(" "), F.lower("p_name"), F.lit("->"), "p_brand", F.lit("* ")).alias("odd")).select("odd", S.canonicalize_strict(F.col("odd")).alias("strict"), S.normalize_mutation(F.col("odd")).alias("normal"), S.safe_key(F.col("odd")).alias("safe"), S.allowed_name(F.col("raw")).alias("allowed"), S.file_name(F.col("odd")).alias("file"), S.text_bool(F.col("raw")).alias("flag"), F.col("raw").rlike("^(?:[A-M])").alias("starts")))
query("SC_03_05_fractions", sql("SELECT site_id, date, sample_id, mutation, af, lod_threshold, false AS af_censored FROM snv"), "af lod_threshold")(lambda s, d: A.snv(s, d).select("site_id", "date", "sample_id", "mutation", "af", "lod_threshold", "af_censored"))
query(
    "SC_11_links",
    sql("SELECT mutation, date, sample_id, site_id, ln(least(greatest(af,1e-12),1-1e-12)/(1-least(greatest(af,1e-12),1-1e-12))) AS logit, 1/(1+exp(-(af-0.5)*8)) AS expit, greatest((af-0.5)*8,0)+ln(1+exp(-abs((af-0.5)*8))) AS softplus FROM snv"),
    "logit expit softplus",
)(lambda s, d: A.snv(s, d).select("mutation", "date", "sample_id", "site_id", S.logit(F.col("af")).alias("logit"), S.expit((F.col("af") - 0.5) * 8).alias("expit"), S.softplus((F.col("af") - 0.5) * 8).alias("softplus")))
query("SC_13_lineage_subset", sql("SELECT site_id, date, sample_id, mutation, count, coverage FROM snv WHERE mutation IN (SELECT mutation FROM signatures WHERE lineage IN ('L1','L3')) AND site_id IN ('S1','S2')"), longs="count coverage")(lambda s, d: A.snv(s, d).select(*P.REQUIRED).filter(F.col("site_id").isin("S1", "S2")).join(A.signatures(s, d).filter(F.col("lineage").isin("L1", "L3")), "mutation", "left_semi"))
query("SC_14_numeric_sanitise", "SELECT count(*) FILTER (WHERE x IS NULL) AS bad, sum(coalesce(x,0)) AS total FROM (SELECT try_cast(CASE WHEN o_orderstatus='F' THEN o_orderpriority ELSE cast(o_totalprice AS varchar) END AS double) AS x FROM orders)", "total", "bad", digits=2)(lambda s, d: A.table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string")).try_cast("double").alias("x")).agg(F.count_if(F.col("x").isNull()).alias("bad"), F.sum(F.coalesce("x", F.lit(0.0))).alias("total")))
query("SC_15_binomial_arrays", sql("SELECT site_id, date, sample_id, mutation, greatest(coverage,0) AS n, least(greatest(count,0),greatest(coverage,0)) AS y, least(greatest(count,0),greatest(coverage,0))/greatest(coverage,1) AS p_obs FROM snv"), "p_obs", "n y")(lambda s, d: A.snv(s, d).select("site_id", "date", "sample_id", "mutation", F.greatest("coverage", F.lit(0)).alias("n"), F.least(F.greatest("count", F.lit(0)), F.greatest("coverage", F.lit(0))).alias("y")).withColumn("p_obs", F.col("y") / F.greatest("n", F.lit(1))))
query("SC_16_coverage_cap", sql("SELECT site_id, date, sample_id, mutation, least(coverage, cap) AS capped FROM snv, (SELECT cast(floor(quantile_cont(coverage,0.98)) AS bigint) AS cap FROM snv)"), longs="capped")(lambda s, d: A.snv(s, d).crossJoin(F.broadcast(A.snv(s, d).agg(F.floor(F.percentile("coverage", F.lit(0.98))).alias("cap")))).select("site_id", "date", "sample_id", "mutation", F.least("coverage", "cap").alias("capped")))
