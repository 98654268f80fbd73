"""Queries of operators.model_reports and of the reports over the model stages, with SQL that computes the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..kernels import particles, special
from ..operators import diagnostics as D
from ..operators import model_reports as R
from ..operators import preprocess as P
from ..operators import signatures as G
from ..registry import query
from . import model_queries as Q
from . import models as M
from .diagnostic_queries import _BAND_SQL, _BANDS, _FIT, _banded, fitted, z
from .signature_queries import _MATRIX, _THETA, matrix, theta

_BB = "lgamma(n+1.0)-lgamma({y}+1.0)-lgamma(n-{y}+1.0)+lgamma({y}+{m}*k)+lgamma(n-{y}+(1-{m})*k)-lgamma(n+k)-lgamma({m}*k)-lgamma((1-{m})*k)+lgamma(k)"
_bb = lambda y, m="mu_t": _BB.format(y=y, m=f"least(greatest({m},1e-12),1-1e-12)")
LEAST = 3
_below = lambda m="mu_t": " + ".join(f"CASE WHEN {k}<=n THEN exp({_bb(k, m)}) ELSE 0 END" for k in range(LEAST))
_DETECT = _FIT + f", e AS (SELECT *, coverage*1.0 AS n, kappa_t AS k FROM fit), dp AS (SELECT *, CASE WHEN n>0 THEN 1-pi-(1-pi)*least({_below()},1.0) ELSE 0.0 END AS p_detect, cast(count>={LEAST} AS double) AS present FROM e)"

query("PRI_22_zibb_logpmf", sql(_FIT + f", e AS (SELECT *, coverage*1.0 AS n, kappa_t AS k, count*1.0 AS y FROM fit WHERE coverage>0) SELECT site_id, date, sample_id, mutation, CASE WHEN y=0 THEN ln(pi+(1-pi)*exp({_bb('y')})) ELSE ln(1-pi)+{_bb('y')} END AS logpmf FROM e"), "logpmf", digits=5)(
    lambda s, d: fitted(s, d).filter("coverage > 0").select("site_id", "date", "sample_id", "mutation", R.zibb_logpmf(F.col("count").cast("double"), F.col("coverage").cast("double"), F.col("mu_t"), F.col("kappa_t"), F.col("pi")).alias("logpmf"))
)
query("NB_12_detection", sql(_DETECT + " SELECT site_id, date, sample_id, mutation, p_detect, present FROM dp"), "p_detect present", digits=5)(lambda s, d: R.detection_scores(fitted(s, d), LEAST).select("site_id", "date", "sample_id", "mutation", "p_detect", "present"))
query("NB_12_detection_summary", sql(_DETECT + " SELECT count(*) AS n, avg(present) AS positive_rate, avg((p_detect-present)*(p_detect-present)) AS brier FROM dp"), "positive_rate brier", "n", digits=5)(lambda s, d: R.detection_summary(R.detection_scores(fitted(s, d), LEAST)))
for _by in ("mutation", "site_id"):
    _mid = "((lo+hi)/2)"
    query(
        f"NB_13_detection_limit_{_by}",
        sql(_FIT + f", g AS (SELECT {_by}, floor(median(coverage)) AS n_star, median(kappa_t) AS kappa_star, median(pi) AS pi_star FROM fit GROUP BY 1), b AS (SELECT *, n_star*1.0 AS n, kappa_star AS k, 1e-6::DOUBLE AS lo, 0.5::DOUBLE AS hi, 0 AS i FROM g UNION ALL SELECT {_by}, n_star, kappa_star, pi_star, n, k, CASE WHEN ok THEN lo ELSE {_mid} END, CASE WHEN ok THEN {_mid} ELSE hi END, i+1 FROM (SELECT *, 1-pi_star-(1-pi_star)*least({_below(_mid)},1.0)>=0.9 AS ok FROM b WHERE i<13)) SELECT {_by}, n_star, kappa_star, pi_star, hi AS lod FROM b WHERE i=13").replace("WITH ", "WITH RECURSIVE ", 1),
        "kappa_star pi_star lod", "n_star", digits=5,
    )(lambda s, d, by=_by: R.detection_limits(fitted(s, d), by, LEAST, 0.9))

_U = "(((doc_id*7919)%1000+0.5)/1000)"
query(
    "NB_15_qa_scorecard",
    sql(_BAND_SQL + f", c AS (SELECT nominal, avg(cast(count BETWEEN lo AND hi AS integer))-max(nominal) AS bias, abs(avg(cast(count>hi AS integer))-avg(cast(count<lo AS integer))) AS asym, CASE WHEN max(nominal)>=0.9 THEN 0.02 ELSE 0.03 END AS tol FROM b GROUP BY nominal), f AS (SELECT cast(abs(avg(z))<=0.05 AS integer)+cast(stddev_samp(z) BETWEEN 0.95 AND 1.05 AS integer)+cast(sqrt(avg(z*z)) BETWEEN 0.95 AND 1.05 AS integer)+cast(avg((count-mean_y)*(count-mean_y))/avg(var_y) BETWEEN 0.9 AND 1.1 AS integer) AS k FROM z),"
        f" rk AS (SELECT {_U} AS u, row_number() OVER (ORDER BY {_U}) AS i, count(*) OVER () AS n FROM documents), ks AS (SELECT max(greatest(i/n-u, u-(i-1)/n)) AS d FROM rk), sc AS (SELECT cast(count>=2 AS integer) AS x, floor(400*mean_y/(1.0+mean_y)) AS i FROM z), cut AS (SELECT i, sum(x) AS p, sum(1-x) AS q FROM sc GROUP BY 1), cu AS (SELECT i, sum(p) OVER o/sum(p) OVER () AS tpr, sum(q) OVER o/sum(q) OVER () AS fpr FROM cut WINDOW o AS (ORDER BY i DESC)), roc AS (SELECT sum((fpr-pf)*(tpr+pt)/2) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER (ORDER BY i DESC),0) AS pf, coalesce(lag(tpr) OVER (ORDER BY i DESC),0) AS pt FROM cu))"
        " SELECT 'Coverage' AS module, printf('%.2f', nominal::DOUBLE) AS metric, bias AS value, CASE WHEN abs(bias)>tol+0.02 OR asym>tol+0.02 THEN 'FLAG' WHEN abs(bias)<=tol AND asym<=tol THEN 'PASS' ELSE 'MINOR' END AS status FROM c UNION ALL SELECT 'PIT', 'KS', d, CASE WHEN d<=0.03 THEN 'PASS' WHEN d<=0.05 THEN 'MINOR' ELSE 'FLAG' END FROM ks UNION ALL SELECT 'Fit', 'z/VR', k, CASE WHEN k=4 THEN 'PASS' WHEN k=3 THEN 'MINOR' ELSE 'FLAG' END FROM f UNION ALL SELECT 'Detection', 'ROC-AUC', auc, CASE WHEN auc>=0.85 THEN 'PASS' WHEN auc>=0.75 THEN 'MINOR' ELSE 'FLAG' END FROM roc"),
    "value", digits=5,
)(
    lambda s, d: R.qa_scorecard(
        D.coverage_table(_banded(s, d), "count", _BANDS),
        D.ks_distance(A.table(s, d, "documents").select((((F.col("doc_id") * 7919) % 1000 + 0.5) / 1000).alias("u")), "u"),
        D.fit_summary(z(s, d)),
        # detection of two counts or more by the expected count
        D.curve_areas(D.threshold_curve(z(s, d).select((F.col("count") >= 2).cast("double").alias("y"), (F.col("mean_y") / (1 + F.col("mean_y"))).alias("p")), "y", "p")).select("roc_auc"),
    )
)
query("NB_29_logistic_qq", sql(", v AS (SELECT coverage AS value, row_number() OVER (ORDER BY coverage) AS i, count(*) OVER () AS n FROM snv), g AS (SELECT value, min(i) AS from_rank, max(i) AS to_rank, max(n) AS n FROM v GROUP BY 1), p AS (SELECT *, ((from_rank+to_rank)/2.0-0.5)/n AS p FROM g) SELECT value, from_rank, to_rank, ln(p/(1-p))/1.702 AS q FROM p"), "q", "value from_rank to_rank")(lambda s, d: R.logistic_qq(A.snv(s, d), "coverage"))

# Dispersions, starting points and prior-only counts
_PRIORS = ", pr AS (SELECT mutation, 1.0+sum(count) AS alpha, 2.0+count(*) AS beta FROM snv WHERE mutation NOT LIKE 'CLICK%' GROUP BY 1)"
_priors = lambda s, d: A.snv(s, d).filter("mutation not like 'CLICK%'").groupBy("mutation").agg((F.sum("count") + 1.0).alias("alpha"), (F.count(F.lit(1)) + 2.0).alias("beta"))
query("FC_19_dispersions", sql(_PRIORS + " SELECT DISTINCT mutation, greatest(coalesce(alpha+beta,(SELECT median(alpha+beta) FROM pr)),1.0) AS phi FROM signatures LEFT JOIN pr USING (mutation)"), "phi")(lambda s, d: R.dispersions(_priors(s, d), A.signatures(s, d)))
_KAPPA = _PRIORS + ", mk AS (SELECT mutation, alpha/(alpha+beta) AS mu, alpha+beta AS kappa FROM pr)"
_mu_kappa = lambda s, d: _priors(s, d).select("mutation", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mu"), (F.col("alpha") + F.col("beta")).alias("kappa"))
query("LIK_18_prior_counts", sql(_KAPPA + " SELECT site_id, date, site_id||'__date' AS sample_id, mutation, kappa*mu AS count, kappa AS coverage FROM (SELECT DISTINCT site_id, date FROM snv), mk"), "count coverage")(lambda s, d: R.prior_counts(_mu_kappa(s, d), A.snv(s, d)))
query("LIK_01_shrunk_priors", sql(", h AS (SELECT mutation, site_id, sum(count)/sum(coverage) AS mu, 5.0+count(*) AS kappa, CASE WHEN site_id IN ('S1','S2') THEN 100.0+sum(coverage)%1000 END AS kappa_shrunk, CASE WHEN site_id='S1' THEN 0.25 END AS mu_shrunk FROM snv GROUP BY mutation, site_id), b AS (SELECT *, row_number() OVER (PARTITION BY mutation ORDER BY kappa_shrunk DESC NULLS LAST, kappa DESC NULLS LAST, coalesce(mu_shrunk,mu)) AS r FROM h) SELECT mutation, least(greatest(coalesce(mu_shrunk,mu,0.5),1e-9),1-1e-9) AS mu, coalesce(kappa_shrunk,kappa,0) AS kappa FROM (SELECT DISTINCT mutation FROM signatures) LEFT JOIN (SELECT * FROM b WHERE r=1) USING (mutation)"), "mu kappa")(
    lambda s, d: M.resolved_priors(A.snv(s, d).groupBy("mutation", "site_id").agg((F.sum("count") / F.sum("coverage")).alias("mu"), (F.count(F.lit(1)) + 5.0).alias("kappa"), F.when(F.col("site_id").isin("S1", "S2"), 100.0 + F.sum("coverage") % 1000).alias("kappa_shrunk"), F.when(F.col("site_id") == "S1", 0.25).alias("mu_shrunk")), A.signatures(s, d))
)

# Shares: residual report, observed and predicted fractions, bands, objectives
_OBS = _MATRIX + _THETA + ", pd AS (SELECT site_id, date, mapped.mutation, least(greatest(sum(theta*mapped.weight),0),1) AS pred_af FROM theta JOIN mapped USING (lineage) GROUP BY ALL), ob AS (SELECT site_id, date, mutation, sum(count)/nullif(sum(coverage),0) AS obs_af FROM snv GROUP BY ALL), op AS (SELECT site_id, date, mutation, CASE WHEN obs_af IS NOT NULL THEN least(greatest(obs_af,0),1) END AS obs_af, pred_af FROM pd LEFT JOIN ob USING (site_id, date, mutation))"
_observed = lambda s, d: R.observed_and_predicted(A.snv(s, d), theta(s, d), matrix(s, d))
query("FC_17_observed_predicted", sql(_OBS + " SELECT * FROM op"), "obs_af pred_af")(lambda s, d: _observed(s, d))
query("FC_17_most_varying", sql(_OBS + ", v AS (SELECT site_id, mutation, var_pop(obs_af) AS variance FROM op GROUP BY ALL) SELECT site_id, mutation, variance, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(variance,12) DESC NULLS LAST, mutation) AS rank FROM v) WHERE rank<=5"), "variance", "rank")(lambda s, d: R.most_varying(_observed(s, d), "obs_af", 5))
query("LIK_17_residual_report", sql(_OBS + " SELECT count(DISTINCT site_id||cast(date AS varchar)) AS samples, count(DISTINCT site_id) AS sites, avg(abs(obs_af-pred_af)) AS mae, sqrt(avg((obs_af-pred_af)*(obs_af-pred_af))) AS rmse FROM op WHERE obs_af IS NOT NULL"), "mae rmse", "samples sites")(lambda s, d: R.residual_report(_observed(s, d).filter("obs_af is not null")))
query("NB_26_share_bands", sql(_THETA + ", s AS (SELECT *, CASE WHEN day(date)%3>0 THEN 0.01+theta/10 END AS theta_sd FROM theta), b AS (SELECT site_id FROM s GROUP BY 1 ORDER BY count(DISTINCT date) DESC, 1 LIMIT 1), t AS (SELECT site_id, date, lineage, theta, coalesce(theta_sd, median(theta_sd) OVER (PARTITION BY lineage)) AS sd FROM s WHERE site_id=(SELECT site_id FROM b)) SELECT site_id, date, lineage, theta, least(greatest(theta-1.96*sd,0),1) AS lo, least(greatest(theta+1.96*sd,0),1) AS hi FROM t"), "theta lo hi")(lambda s, d: R.share_bands(theta(s, d).withColumn("theta_sd", F.when(F.dayofmonth("date") % 3 > 0, 0.01 + F.col("theta") / 10))))
query("NB_27_median_objective", sql(" SELECT day(date) AS iter, median(coverage*1.0) AS objective, count(*) AS sites FROM snv GROUP BY 1"), "objective", "iter sites")(lambda s, d: R.median_objective(A.snv(s, d).select(F.dayofmonth("date").alias("iter"), F.col("coverage").cast("double").alias("objective"))))
query("SIG_07_manual", sql(_MATRIX + " SELECT min(lineage) AS lineage, mutation, CASE mutation WHEN (SELECT min(mutation) FROM mapped) THEN 1 ELSE 2 END AS rank FROM mapped WHERE mutation IN ((SELECT min(mutation) FROM mapped),(SELECT max(mutation) FROM mapped)) GROUP BY mutation"), longs="rank")(lambda s, d: _manual(s, d))


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = matrix(spark, sf_dir).agg(F.min("mutation"), F.max("mutation")).first()
    return G.selected_mutations(matrix(spark, sf_dir), None, "manual", 0, [f" {ends[0].lower()}", ends[1]])


# Likelihood residuals: what is observed has SQL; what is predicted must be the shares times the matrix
_CELLS = _MATRIX + ", names AS (SELECT DISTINCT mutation FROM mapped), cells AS (SELECT site_id, date, mutation, sum(count) AS y, sum(coverage) AS n FROM snv JOIN names USING (mutation) GROUP BY ALL), grid AS (SELECT site_id, date, mutation, coalesce(y,0)*1.0 AS y, coalesce(n,0)*1.0 AS n FROM (SELECT DISTINCT site_id, date FROM cells) CROSS JOIN names LEFT JOIN cells USING (site_id, date, mutation)), cap AS (SELECT site_id, date, quantile_cont(n::DOUBLE,0.999) AS cap FROM grid GROUP BY ALL)"
query("LIK_14_observed", sql(_CELLS + " SELECT site_id, date, mutation, CASE WHEN least(n,cap)>0 THEN y/greatest(least(n,cap),1) ELSE 0 END AS obs_af, least(n,cap) AS coverage, 0.0 AS gap FROM grid JOIN cap USING (site_id, date)"), "obs_af coverage gap")(lambda s, d: _residuals(s, d))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = Q.shares(spark, sf_dir)
    pred = tagged.filter("kind = 'theta'").select("site_id", "date", "lineage", "theta").join(matrix(spark, sf_dir), "lineage").groupBy("site_id", "date", "mutation").agg(F.sum(F.col("theta") * F.col("weight")).alias("p"))
    return tagged.filter("kind = 'residual'").select("site_id", "date", "mutation", "obs_af", "coverage", "pred_af").join(pred, ["site_id", "date", "mutation"]).select("site_id", "date", "mutation", "obs_af", "coverage", (F.col("pred_af") - F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))).alias("gap"))


# Approximations and tests
query("BAS_10_bb_moments", sql(", k AS (SELECT DISTINCT count AS y, coverage*1.0 AS n, 2.0+count AS a, 3.0+coverage-count AS b FROM snv) SELECT cast(y AS bigint) AS y, n, n*a/(a+b) AS mean, n*(a*b/((a+b)*(a+b)))*(a+b+n)/(a+b+1) AS var FROM k"), "n mean var")(
    lambda s, d: A.snv(s, d).select(F.col("count").alias("y"), F.col("coverage").cast("double").alias("n")).distinct().withColumns({"a": 2.0 + F.col("y"), "b": 3.0 + F.col("n") - F.col("y")}).select("y", "n", R.bb_moments(F.col("n"), F.col("a"), F.col("b"))[0].alias("mean"), R.bb_moments(F.col("n"), F.col("a"), F.col("b"))[1].alias("var"))
)


def correlation_tests(r: DataFrame) -> DataFrame:
    """Two-sided p-values of the one row of correlations, by Student's t."""

    def run(batches):
        for b in batches:
            for name in ("pearson", "spearman"):
                t = b[f"{name}_r"] * ((b["n"] - 2) / (1 - b[f"{name}_r"] ** 2)) ** 0.5
                b[f"{name}_p"] = [float(2 * special.t_cdf(-abs(x), n - 2)) if n > 2 and x == x else None for x, n in zip(t, b["n"], strict=True)]
            yield b[["pearson_r", "pearson_p", "spearman_r", "spearman_p", "n"]]

    return r.mapInPandas(run, "pearson_r double, pearson_p double, spearman_r double, spearman_p double, n long")


_SIMPSON = "1-2*(SELECT sum((CASE WHEN i=0 OR i=4000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*exp(lgamma((n-1)/2.0)-lgamma((n-2)/2.0)-0.5*ln((n-2)*pi())-(n-1)/2.0*ln(1+power({t}*i/4000.0,2)/(n-2))))*{t}/4000.0/3 FROM (SELECT unnest(range(4001)) AS i))"
query(
    "PRE_11_correlation_tests",
    sql(", v AS (SELECT count*1.0 AS a, (coverage-count)*1.0 AS r FROM snv), k AS (SELECT a, r, rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2 AS ra, rank() OVER (ORDER BY r)+(count(*) OVER (PARTITION BY r)-1)/2 AS rr FROM v), c AS (SELECT corr(a,r) AS pearson_r, corr(ra,rr) AS spearman_r, count(*) AS n FROM k), t AS (SELECT *, abs(pearson_r)*sqrt((n-2)/(1-pearson_r*pearson_r)) AS t1, abs(spearman_r)*sqrt((n-2)/(1-spearman_r*spearman_r)) AS t2 FROM c)"
        f" SELECT pearson_r, greatest({_SIMPSON.format(t='t1')},0) AS pearson_p, spearman_r, greatest({_SIMPSON.format(t='t2')},0) AS spearman_p, n FROM t"),
    "pearson_r pearson_p spearman_r spearman_p", "n", digits=5,
)(lambda s, d: correlation_tests(P.alt_ref_correlation(A.snv(s, d))))

# Forecasts over a baseline and priors
query("FC_20_acceptance")(lambda s, d: R.acceptance(Q.forecasts(s, d, "ess", "pit", "elpd", "qq"), particles.Settings().particles))
query("FC_15_delta_elpd")(lambda s, d: M.site_forecasts(A.snv(s, d), matrix(s, d), R.dispersions(_priors(s, d), matrix(s, d)), baseline=theta(s, d).select("site_id", "date", "lineage", "theta"), kinds=("elpd", "delta_elpd")).select("site_id", "kind", "value"))


# Summaries of fitted rows over observed ones, which SQL can follow
_OBSERVED = ", pool AS (SELECT mutation, sum(count)/sum(coverage) AS rate FROM snv GROUP BY 1), ob AS (SELECT site_id, date, mutation, avg(af) AS af, avg(coverage) AS n FROM snv GROUP BY ALL), zz AS (SELECT site_id, date, abs(af-p)/sqrt(greatest(p*(1-p)*(n+20)/(n*21),1e-12)) AS z FROM (SELECT ob.site_id, ob.date, af, greatest(n,1) AS n, least(greatest(rate,1e-12),1-1e-12) AS p FROM ob JOIN pool USING (mutation))), ph AS (SELECT site_id, date, greatest(median(z)/0.67449,1) AS phi FROM zz GROUP BY ALL)"


def _observed_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv = A.snv(spark, sf_dir)
    pool = snv.groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("pred_af"))
    return snv.groupBy("site_id", "date", "mutation").agg(F.avg("af").alias("obs_af"), F.avg("coverage").alias("coverage")).join(pool, "mutation").withColumn("kappa", F.lit(20.0))


query("LIK_15_16_observed", sql(_OBSERVED + " SELECT site_id, date, mutation AS lineage, (0.1*af+0.01)*sqrt(phi) AS theta_sd FROM ob JOIN ph USING (site_id, date)"), "theta_sd")(
    lambda s, d: M.calibrated_uncertainty(_observed_residuals(s, d).select("site_id", "date", F.col("mutation").alias("lineage"), (0.1 * F.col("obs_af") + 0.01).alias("theta_sd")), _observed_residuals(s, d))
)
query("FC_20_observed_acceptance", sql(", q AS (SELECT site_id, sqrt(avg(power(0.1*count+0.5,2))) AS rmse FROM snv GROUP BY 1) SELECT median(coverage/200.0) AS median_ness, avg(cast(coverage/200.0<0.2 AS integer)) AS frac_ness_low, avg(af) AS pit_mean, var_samp(af) AS pit_var, avg(-coverage/10.0) AS mean_elpd_waic, avg(coverage/5.0) AS mean_waic, (SELECT avg(rmse) FROM q) AS rmse_counts_mean FROM snv"), "median_ness frac_ness_low pit_mean pit_var mean_elpd_waic mean_waic rmse_counts_mean")(
    lambda s, d: R.acceptance(A.snv(s, d).select("site_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("double").alias("value"), F.col("count").cast("double").alias("observed")) for k, v in (("ess", F.col("coverage")), ("pit", F.col("af")), ("elpd", F.col("coverage") / -10), ("qq", F.col("count") * 1.1 + 0.5)))))), 200)
)

__all__ = ["correlation_tests"]
