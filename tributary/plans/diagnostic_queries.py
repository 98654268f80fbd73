"""Queries of the diagnostics, over a simple fit that SQL can state as well: pooled rates per mutation, fixed concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..operators import diagnostics as D
from ..registry import query

_FIT = ", m AS (SELECT mutation, sum(count)/sum(coverage) AS mu_t FROM snv GROUP BY 1), fit AS (SELECT site_id, date, sample_id, mutation, count, coverage, af, mu_t, 30.0 AS kappa_t, 0.05 AS pi FROM snv JOIN m USING (mutation)), zz AS (SELECT *, 0.95*coverage*mu_t AS mean_y, 0.95*(coverage*mu_t*(1-mu_t)*(30.0+coverage)/31.0+0.05*coverage*mu_t*coverage*mu_t) AS var_y FROM fit), z AS (SELECT *, (count-mean_y)/sqrt(greatest(var_y,1e-12)) AS z, (count-mean_y) AS e FROM zz)"


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv = A.snv(spark, sf_dir)
    m = snv.groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("mu_t"))
    return snv.join(m, "mutation").select("site_id", "date", "sample_id", "mutation", "count", "coverage", "af", "mu_t", F.lit(30.0).alias("kappa_t"), F.lit(0.05).alias("pi"))


def z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.standardised(fitted(spark, sf_dir))


query("NB_01_standardised", sql(_FIT + " SELECT site_id, date, sample_id, mutation, mean_y, var_y, z FROM z"), "mean_y var_y z", digits=5)(lambda s, d: z(s, d).select("site_id", "date", "sample_id", "mutation", "mean_y", "var_y", "z"))
query("NB_07_fit_summary", sql(_FIT + ", c AS (SELECT *, avg(z) OVER () AS mz FROM z) SELECT count(*) AS n, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, avg(z) AS mean_z, stddev_samp(z) AS sd_z, sqrt(avg(z*z)) AS rmsz, avg(power(z-mz,3))/power(avg(power(z-mz,2)),1.5) AS skew, avg(power(z-mz,4))/power(avg(power(z-mz,2)),2)-3 AS kurtosis, avg(e*e)/avg(var_y) AS variance_ratio, regr_slope(count,mean_y) AS slope, regr_intercept(count,mean_y) AS intercept, regr_r2(count,mean_y) AS r2 FROM c"), "rmse mae mean_z sd_z rmsz skew kurtosis variance_ratio slope intercept r2", "n", digits=5)(lambda s, d: D.fit_summary(z(s, d)))
_BANDS = {0.5: ("lo50", "hi50"), 0.9: ("lo90", "hi90")}
_banded = lambda s, d: z(s, d).withColumns({f"{e}{t}": F.col("mean_y") + k * F.sqrt("var_y") * (-1 if e == "lo" else 1) for t, k in ((50, 0.6744897501960817), (90, 1.6448536269514722)) for e in ("lo", "hi")})
_BAND_SQL = _FIT + ", b AS (SELECT *, 0.5 AS nominal, mean_y-0.6744897501960817*sqrt(var_y) AS lo, mean_y+0.6744897501960817*sqrt(var_y) AS hi FROM z UNION ALL SELECT *, 0.9, mean_y-1.6448536269514722*sqrt(var_y), mean_y+1.6448536269514722*sqrt(var_y) FROM z)"
_COVER = "count(*) AS n, avg(cast(count BETWEEN lo AND hi AS integer)) AS empirical, avg(cast(count BETWEEN lo AND hi AS integer))-max(nominal) AS bias, avg(cast(count<lo AS integer)) AS miss_low, avg(cast(count>hi AS integer)) AS miss_high, avg(hi-lo) AS width"
query("NB_03_coverage_table", sql(_BAND_SQL + f" SELECT nominal, {_COVER} FROM b GROUP BY nominal"), "nominal empirical bias miss_low miss_high width", "n", digits=5)(lambda s, d: D.coverage_table(_banded(s, d), "count", _BANDS).drop("ci_lo", "ci_hi"))
query("NB_04_coverage_by_decile", sql(_BAND_SQL + f", q AS (SELECT list_distinct([quantile_cont(mean_y,0.1*1),quantile_cont(mean_y,0.2),quantile_cont(mean_y,0.3),quantile_cont(mean_y,0.4),quantile_cont(mean_y,0.5),quantile_cont(mean_y,0.6),quantile_cont(mean_y,0.7),quantile_cont(mean_y,0.8),quantile_cont(mean_y,0.9)]) AS eg FROM z) SELECT len(list_filter(eg, lambda x: x<mean_y)) AS bin, nominal, {_COVER} FROM b, q GROUP BY ALL"), "nominal empirical bias miss_low miss_high width", "bin n", digits=4)(lambda s, d: D.coverage_table(D.quantile_bin(_banded(s, d), "mean_y", 10), "count", _BANDS, ["bin"]).drop("ci_lo", "ci_hi"))
_U = "(((doc_id*7919)%1000+0.5)/1000)"
_docs = lambda s, d: A.table(s, d, "documents").select("doc_id", "source", ((F.col("doc_id") * 7919) % 1000 + 0.5).alias("u")).withColumn("u", F.col("u") / 1000)
query("NB_05_transform_statistics", f"WITH u AS (SELECT {_U} AS u FROM documents), h AS (SELECT sum(k) AS n, sum(k*k)*20/sum(k)-sum(k) AS chi2 FROM (SELECT least(floor(u*20),19) AS b, count(*) AS k FROM u GROUP BY 1)), r AS (SELECT u, rank() OVER (ORDER BY u) AS lo, count(*) OVER (PARTITION BY u) AS k FROM u) SELECT n, chi2, (SELECT sum(power(u-(2*(lo+j)-1)/(2.0*n),2)) FROM (SELECT u, lo, row_number() OVER (PARTITION BY u)-1 AS j FROM r))+1/(12.0*n) AS cvm FROM h", "chi2 cvm", "n", digits=5)(lambda s, d: D.transform_statistics(_docs(s, d), "u"))
query("NB_06_ks_by_source", f"WITH r AS (SELECT source, {_U} AS u, row_number() OVER (PARTITION BY source ORDER BY {_U}) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(n) AS n, max(greatest(i/n-u, u-(i-1)/n)) AS d FROM r GROUP BY 1 HAVING max(n)>=10", "d", "n")(lambda s, d: D.ks_distance(_docs(s, d), "u", ["source"], 10))
_SUMMARY = lambda c: f"SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, max({c}) AS max, (SELECT avg(power({c}-m,3))/power(avg(power({c}-m,2)),1.5) FROM t, (SELECT avg({c}) AS m FROM t)) AS skew, (SELECT avg(power({c}-m,4))/power(avg(power({c}-m,2)),2)-3 FROM t, (SELECT avg({c}) AS m FROM t)) AS kurtosis, " + ", ".join(f"quantile_cont({c},{q}) AS q{int(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM t"
query("NB_08_variable_summary", f"WITH t AS (SELECT value, cast(user_id AS double) AS user_id FROM events) {_SUMMARY('value')} UNION ALL {_SUMMARY('user_id')}", "mean sd min max skew kurtosis q01 q05 q25 q50 q75 q95 q99", "n", digits=5)(lambda s, d: D.variable_summary(A.table(s, d, "events").select("value", F.col("user_id").cast("double").alias("user_id")), ["value", "user_id"]))
query("NB_09_histogram", "SELECT least(floor(least(greatest(value,0),300)*(60/300.0)),59) AS bin, count(*) AS n FROM events GROUP BY 1", longs="bin n")(lambda s, d: D.histogram(A.table(s, d, "events"), "value", 0.0, 300.0))
query("NB_10_kendall_tau", "WITH c AS (SELECT user_id%13 AS x, cast(floor(value/20) AS bigint) AS y, count(*) AS k FROM events GROUP BY ALL), s AS (SELECT sum(sign(b.y-a.y)*a.k*b.k) AS s FROM c a JOIN c b ON a.x<b.x), n AS (SELECT sum(k)*(sum(k)-1)/2 AS n0 FROM c), tx AS (SELECT sum(k*(k-1)/2) AS t FROM (SELECT sum(k) AS k FROM c GROUP BY x)), ty AS (SELECT sum(k*(k-1)/2) AS t FROM (SELECT sum(k) AS k FROM c GROUP BY y)) SELECT s/sqrt((n0-tx.t)*(n0-ty.t)) AS tau_b FROM s, n, tx, ty", "tau_b")(lambda s, d: D.kendall_tau(A.table(s, d, "events").select((F.col("user_id") % 13).alias("x"), F.floor(F.col("value") / 20).cast("long").alias("y")), "x", "y"))
_CURVE = "WITH p AS (SELECT cast(quality AS double) AS y, ((doc_id*7919)%1000+0.5)/1000 AS p FROM labels), g AS (SELECT cast(floor(p*400) AS bigint) AS i, sum(y) AS a, sum(1-y) AS b FROM p GROUP BY 1), t AS (SELECT i, sum(coalesce(a,0)) OVER w AS tp, sum(coalesce(b,0)) OVER w AS fp, sum(coalesce(a,0)) OVER () AS np, sum(coalesce(b,0)) OVER () AS nn FROM (SELECT unnest(range(401)) AS i) LEFT JOIN g USING (i) WINDOW w AS (ORDER BY i DESC)), c AS (SELECT i, i/400 AS threshold, tp/np AS tpr, fp/nn AS fpr, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1 END AS precision FROM t)"
_curve = lambda s, d: D.threshold_curve(A.table(s, d, "labels").select(F.col("quality").cast("double").alias("y"), (((F.col("doc_id") * 7919) % 1000 + 0.5) / 1000).alias("p")), "y", "p")
query("NB_11_threshold_curve", _CURVE + " SELECT * FROM c", "threshold tpr fpr precision", "i")(_curve)
query("NB_11_curve_areas", _CURVE + ", l AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY i DESC),0) AS px, coalesce(lag(tpr) OVER (ORDER BY i DESC),0) AS py, coalesce(lag(precision) OVER (ORDER BY i DESC),1) AS pp FROM c) SELECT sum((fpr-px)*(tpr+py)/2) AS roc_auc, sum((tpr-py)*(precision+pp)/2) AS pr_auc, avg(precision) AS mean_precision FROM l", "roc_auc pr_auc mean_precision")(lambda s, d: D.curve_areas(_curve(s, d)))
query("NB_14_outliers", sql(_BAND_SQL + " SELECT mutation, count(*) AS n FROM z WHERE abs(z)>2.5758293035489004 GROUP BY 1"), longs="n")(lambda s, d: z(s, d).filter(F.abs("z") > 2.5758293035489004).groupBy("mutation").agg(F.count(F.lit(1)).alias("n")))
query("NB_15_scorecard", sql(_FIT + ", k AS (SELECT avg(z) AS m, stddev_samp(z)-1 AS s FROM z), c AS (SELECT 'mean_z' AS \"check\", m AS value, 0.05 AS a, 0.1 AS b FROM k UNION ALL SELECT 'sd_z', s, 0.05, 0.1 FROM k) SELECT \"check\", value, CASE WHEN abs(value)<=a THEN 'PASS' WHEN abs(value)<=b THEN 'MINOR' ELSE 'FLAG' END AS verdict FROM c"), "value", digits=5)(lambda s, d: D.scorecard(z(s, d).agg(F.avg("z").alias("m"), (F.stddev_samp("z") - 1).alias("s")).select(F.inline(F.array(F.struct(F.lit("mean_z").alias("check"), F.col("m").alias("value"), F.lit(0.05).alias("pass_at"), F.lit(0.1).alias("minor_at")), F.struct(F.lit("sd_z").alias("check"), F.col("s").alias("value"), F.lit(0.05).alias("pass_at"), F.lit(0.1).alias("minor_at")))))))
query("NB_16_rows_per_day", sql(_FIT + " SELECT date, mutation, count(*) AS n, avg(mu_t) AS mean_mu FROM fit GROUP BY ALL"), "mean_mu", "n")(lambda s, d: fitted(s, d).groupBy("date", "mutation").agg(F.count(F.lit(1)).alias("n"), F.avg("mu_t").alias("mean_mu")))
query("NB_30_proportional_sample", sql(", t AS (SELECT site_id, round(count(*)*500.0/sum(count(*)) OVER ()) AS take FROM snv GROUP BY 1), r AS (SELECT site_id, date, sample_id, mutation, take, row_number() OVER (PARTITION BY site_id ORDER BY md5(concat_ws('|','11',cast(date AS varchar),sample_id,mutation)), date, sample_id, mutation) AS i FROM snv JOIN t USING (site_id)) SELECT site_id, date, sample_id, mutation FROM r WHERE i<=take"))(lambda s, d: D.proportional_sample(A.snv(s, d), "site_id", ["date", "sample_id", "mutation"], 500).select("site_id", "date", "sample_id", "mutation"))
query("NB_31_decile_profile", sql(_FIT + ", q AS (SELECT list_distinct([quantile_cont(mean_y,0.25),quantile_cont(mean_y,0.5),quantile_cont(mean_y,0.75)]) AS eg FROM z) SELECT len(list_filter(eg, lambda x: x<mean_y)) AS bin, count(*) AS n, median(coverage) AS coverage, median(mu_t) AS mu FROM z, q GROUP BY 1"), "coverage mu", "bin n")(lambda s, d: D.quantile_bin(z(s, d), "mean_y", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.median("coverage").alias("coverage"), F.median("mu_t").alias("mu")))
