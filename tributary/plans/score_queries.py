"""Queries over model evidence and forecast scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..functions import scalars as S
from ..operators import evidence as V
from ..operators import metrics as M
from ..operators import preprocess as P
from ..registry import query

# Scoring pairs: a label against a probability from its id; sizes and weights from orders.
_PAIRS = "SELECT doc_id, cast(quality AS double) AS y, ((doc_id*7919)%1000+0.5)/1000 AS p, 1.0+doc_id%5 AS w FROM labels"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), (((F.col("doc_id") * 7919) % 1000 + 0.5) / 1000).alias("p"), (F.col("doc_id") % 5 + 1.0).alias("w"))


query("MET_01_02_06_errors", f"SELECT sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae, avg((y-p)*(y-p)) AS brier, sqrt(sum(w*(y-p)*(y-p))/sum(w)) AS wrmse, sum(w*abs(y-p))/sum(w) AS wmae, sum(w*(y-p)*(y-p))/sum(w) AS wbrier FROM ({_PAIRS})", "rmse mae brier wrmse wmae wbrier")(lambda s, d: pairs(s, d).agg(M.rmse(F.col("y"), F.col("p")).alias("rmse"), M.mae(F.col("y"), F.col("p")).alias("mae"), M.brier(F.col("y"), F.col("p")).alias("brier"), M.rmse(F.col("y"), F.col("p"), F.col("w")).alias("wrmse"), M.mae(F.col("y"), F.col("p"), F.col("w")).alias("wmae"), M.brier(F.col("y"), F.col("p"), F.col("w")).alias("wbrier")))
query("MET_07_interval_coverage", "SELECT avg(cast(o_totalprice BETWEEN 50000 AND 200000 AS integer)) AS coverage, avg(cast(o_totalprice BETWEEN 50000 AND 200000 AS integer))-0.9 AS delta FROM orders", "coverage delta")(lambda s, d: A.table(s, d, "orders").agg(M.interval_coverage(F.col("o_totalprice"), F.lit(50000), F.lit(200000)).alias("coverage")).withColumn("delta", F.col("coverage") - 0.9))
_VECS = "SELECT vec_id, i, abs(x)+0.001 AS x, (i*37)%11+1.0 AS q FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::double AS x FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), (F.abs(F.col("x").cast("double")) + 0.001).alias("x"), ((F.col("i") * 37) % 11 + 1.0).alias("q"))


query("MET_03_divergence", f"WITH v AS ({_VECS}), n AS (SELECT vec_id, (x+1e-12)/sum(x+1e-12) OVER g AS p, (q+1e-12)/sum(q+1e-12) OVER g AS q FROM v WINDOW g AS (PARTITION BY vec_id)) SELECT vec_id, sum(p*log2(p/q)) AS kl, sum((p*log2(2*p/(p+q))+q*log2(2*q/(p+q)))/2) AS js FROM n GROUP BY 1", "kl js")(lambda s, d: M.divergence(vectors(s, d), ["vec_id"], "x", "q"))
query("MET_04_crps_samples", f"WITH v AS (SELECT vec_id, x, 0.1 AS y, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM ({_VECS})) SELECT vec_id, avg(abs(x-y))-sum((2*k-n-1)*x)/max(n*n) AS crps FROM v GROUP BY 1", "crps")(lambda s, d: M.crps_samples(vectors(s, d).withColumn("y", F.lit(0.1)), ["vec_id"], "x", "y"))
query("MET_08_calibration_uniform", f"WITH b AS (SELECT least(floor(p*10),9) AS bin, avg(y) AS acc, avg(p) AS conf, count(*) AS count FROM ({_PAIRS}) GROUP BY 1) SELECT bin, acc, conf, count, count/sum(count) OVER () AS mass, count/sum(count) OVER ()*abs(acc-conf) AS contribution, bin/10 AS lower, (bin+1)/10 AS upper FROM b", "acc conf mass contribution lower upper", "bin count")(lambda s, d: M.calibration_bins(pairs(s, d), "y", "p"))
query("MET_08_calibration_quantile", f"WITH r AS (SELECT y, p, row_number() OVER (ORDER BY p, y) AS k, count(*) OVER () AS n FROM ({_PAIRS})), b AS (SELECT least(floor(k*10/(n+1)),9) AS bin, avg(y) AS acc, avg(p) AS conf, count(*) AS count FROM r GROUP BY 1) SELECT bin, acc, conf, count, count/sum(count) OVER () AS mass, count/sum(count) OVER ()*abs(acc-conf) AS contribution, bin/10 AS lower, (bin+1)/10 AS upper FROM b", "acc conf mass contribution lower upper", "bin count")(lambda s, d: M.calibration_bins(pairs(s, d), "y", "p", strategy="quantile"))
query("MET_08_ece", f"WITH b AS (SELECT least(floor(p*10),9) AS bin, avg(y) AS acc, avg(p) AS conf, count(*) AS n FROM ({_PAIRS}) GROUP BY 1) SELECT sum(n*abs(acc-conf))/sum(n) AS ece FROM b", "ece")(lambda s, d: M.expected_calibration_error(pairs(s, d), "y", "p"))
query("MET_09_11_weights", f"WITH p AS (SELECT vec_id, x/sum(x) OVER (PARTITION BY vec_id) AS p FROM ({_VECS})) SELECT vec_id, 1/sum(p*p) AS ess, 1/sum(p*p)/count(*) AS ness, sum(-p*ln(p)) AS entropy, sum(-p*ln(p))/ln(count(*)) AS entropy_norm, 1-1/sum(p*p)/count(*) AS degeneracy FROM p GROUP BY 1", "ess ness entropy entropy_norm degeneracy")(lambda s, d: M.weight_diagnostics(vectors(s, d), ["vec_id"], "x"))
_LL = f"SELECT vec_id, -x*10 AS ll, -(x*8+q/10) AS lb FROM ({_VECS})"
_PW = lambda c, name: f"""{name}a AS (SELECT vec_id, {c} AS ll, max({c}) OVER g AS top, min({c}) OVER g AS low FROM l WINDOW g AS (PARTITION BY vec_id)), {name}b AS (SELECT vec_id, top+ln(avg(exp(ll-top))) AS lppd, var_samp(ll) AS p_waic, ln(avg(exp(low-ll)))-low AS m FROM {name}a GROUP BY vec_id, top, low),
 {name} AS (SELECT vec_id, lppd, p_waic, lppd-p_waic AS elpd_waic, -ln(avg(exp(least(-ll, m+ln(10))))) AS elpd_loo FROM {name}a JOIN {name}b USING (vec_id) GROUP BY ALL)"""  # noqa: E731
_loglik = lambda s, d: vectors(s, d).select("vec_id", (-F.col("x") * 10).alias("ll"), (-(F.col("x") * 8 + F.col("q") / 10)).alias("lb"))
query("MET_12_waic_pointwise", f"WITH l AS ({_LL}), {_PW('ll', 'w')} SELECT * FROM w", "lppd p_waic elpd_waic elpd_loo")(lambda s, d: M.waic_pointwise(_loglik(s, d), "vec_id", "ll"))
query("MET_12_waic_summary", f"WITH l AS ({_LL}), {_PW('ll', 'w')} SELECT -2*sum(elpd_waic) AS waic, sum(elpd_waic) AS elpd_waic, sum(p_waic) AS p_waic, sum(lppd) AS lppd, sum(elpd_loo) AS elpd_loo, sqrt(count(*)*var_samp(elpd_loo)) AS elpd_loo_se FROM w", "waic elpd_waic p_waic lppd elpd_loo elpd_loo_se")(lambda s, d: M.waic_summary(M.waic_pointwise(_loglik(s, d), "vec_id", "ll")))
query("MET_12_waic_delta", f"WITH l AS ({_LL}), {_PW('ll', 'w')}, {_PW('lb', 'v')}, d AS (SELECT w.elpd_waic-v.elpd_waic AS dw, w.elpd_loo-v.elpd_loo AS dl FROM w JOIN v USING (vec_id)) SELECT sum(dw) AS delta_elpd_waic, sqrt(count(*)*var_samp(dw)) AS delta_elpd_waic_se, sum(dl) AS delta_elpd_loo, sqrt(count(*)*var_samp(dl)) AS delta_elpd_loo_se FROM d", "delta_elpd_waic delta_elpd_waic_se delta_elpd_loo delta_elpd_loo_se")(lambda s, d: M.waic_delta(M.waic_pointwise(_loglik(s, d), "vec_id", "ll"), M.waic_pointwise(_loglik(s, d).select("vec_id", "lb"), "vec_id", "lb"), "vec_id"))
_FLAG = sql(", fl AS (SELECT site_id, mutation AS lineage, date, af>0.3 AS threshold_crossed FROM snv), re AS (SELECT site_id, mutation AS lineage, min(date) AS ref_date FROM snv GROUP BY ALL)")
query("MET_13_detection_delay", _FLAG + " SELECT site_id, lineage, ref_date, first_date, cast(date_diff('day', ref_date, first_date) AS double) AS delay_days FROM re LEFT JOIN (SELECT site_id, lineage, min(date) AS first_date FROM fl WHERE threshold_crossed GROUP BY ALL) USING (site_id, lineage)", "delay_days")(lambda s, d: A.snv(s, d).transform(lambda x: M.detection_delay(x.select("site_id", F.col("mutation").alias("lineage"), "date", (F.col("af") > 0.3).alias("threshold_crossed")), x.groupBy("site_id", F.col("mutation").alias("lineage")).agg(F.min("date").alias("ref_date")))))
for _q in (0.5, 0.9):
    query(f"MET_14_weighted_quantile_{int(_q * 100)}", f"SELECT o_orderstatus, min(o_totalprice) AS value FROM (SELECT *, sum(w) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS c, sum(w) OVER (PARTITION BY o_orderstatus) AS t FROM (SELECT *, o_custkey%3+1 AS w FROM orders)) WHERE c>={_q}*(t+1e-12) GROUP BY 1", "value")(lambda s, d, q=_q: M.weighted_quantile(A.table(s, d, "orders").withColumn("w", F.col("o_custkey") % 3 + 1), ["o_orderstatus"], "o_totalprice", "w", q))
_CI = "avg(v)-1.959963984540054*coalesce(stddev_samp(v),0)/sqrt(count(*)) AS ci_lower, avg(v)+1.959963984540054*coalesce(stddev_samp(v),0)/sqrt(count(*)) AS ci_upper"
_STRATA = f"WITH o AS (SELECT o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS v FROM orders) SELECT 'overall' AS scope, NULL AS st, NULL AS pr, avg(v) AS value, count(*) AS n, {_CI} FROM o UNION ALL SELECT 'st', st, NULL, avg(v), count(*), {_CI} FROM o GROUP BY st UNION ALL SELECT 'pr', NULL, pr, avg(v), count(*), {_CI} FROM o GROUP BY pr UNION ALL SELECT 'all', st, pr, avg(v), count(*), {_CI} FROM o GROUP BY st, pr"
_strata = lambda s, d: M.stratified(A.table(s, d, "orders").select(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("v")), "v", ["st", "pr"])
query("MET_15_stratified", _STRATA, "value ci_lower ci_upper", "n", digits=4)(_strata)
query("MET_15_disparity", f"SELECT scope, max(value)-min(value) AS gap, max(value)/min(value) AS ratio FROM ({_STRATA}) GROUP BY 1", "gap ratio", digits=4)(lambda s, d: M.disparity(_strata(s, d)))
query("MET_16_qq_points", "SELECT row_number() OVER (ORDER BY c_acctbal) AS i, (row_number() OVER (ORDER BY c_acctbal)-0.375)/(count(*) OVER ()+0.25) AS p, c_acctbal AS q_emp FROM customer", "p q_emp", "i")(lambda s, d: M.qq_points(A.table(s, d, "customer"), "c_acctbal").select("i", S.normal_cdf(F.col("q_theory")).alias("p"), "q_emp"))
query("SF_01_lgamma", "SELECT p_partkey, lgamma(p_size/7.0) AS a, lgamma(p_retailprice) AS b, lgamma(p_size+2.0)-lgamma(3.0)-lgamma(p_size+0.0) AS choose2 FROM part", "a b choose2")(lambda s, d: A.table(s, d, "part").select("p_partkey", S.lgamma(F.col("p_size") / 7.0).alias("a"), S.lgamma(F.col("p_retailprice")).alias("b"), S.log_choose(F.col("p_size") + 1.0, F.lit(2.0)).alias("choose2")))

# Evidence
_ST = ", st AS (SELECT cast(count(*) AS double) AS n, sum(count) AS sy, sum(coverage) AS sn, sum(cast(count>0 AS integer)) AS sx, sum(lgamma(count+1.0)) AS slf, sum(lgamma(coverage+1.0)-lgamma(count+1.0)-lgamma(coverage-count+1.0)) AS slc, var_pop(count)*count(*) AS sse, var_samp(count) AS v FROM snv)"
_BL = lambda a, b: f"(lgamma({a})+lgamma({b})-lgamma({a}+{b}))"
_LOG = {
    "binomial": lambda a, b: f"{_BL(f'({a}+sy)', f'({b}+sn-sy)')}-{_BL(f'cast({a} AS double)', f'cast({b} AS double)')}",
    "bernoulli": lambda a, b: f"{_BL(f'({a}+sx)', f'({b}+n-sx)')}-{_BL(f'cast({a} AS double)', f'cast({b} AS double)')}",
    "poisson": lambda a, b: f"-slf+{a}*ln({b})-({a}+sy)*ln({b}+n)+lgamma({a}+sy)-lgamma(cast({a} AS double))",
    "gaussian": lambda k, a: f"lgamma({a}+n/2)-lgamma(cast({a} AS double))+{a}*ln(v*greatest(1,{a}-1))-({a}+n/2)*ln(v*greatest(1,{a}-1)+sse/2)+0.5*(ln({k})-ln({k}+n))-0.5*n*ln({math.pi})",
}
_EV = _ST + ", ev AS (" + " UNION ALL ".join(f"SELECT '{f}:{p}' AS model_id, '{f}' AS family, '{p}' AS prior_name, {_LOG[f](a, b)} AS log_evidence FROM st" for f, p, a, b in V.MODELS) + ")"
query("BAS_01_05_evidence", sql(_EV + " SELECT * FROM ev"), "log_evidence", digits=3)(lambda s, d: V.evidence(A.snv(s, d)))
query("BAS_01_combinatorial_constant", sql(_ST + " SELECT slc, slf FROM st"), "slc slf", digits=3)(lambda s, d: V.sufficient_statistics(A.snv(s, d)).select("slc", "slf"))
_POST = _EV + ", ds AS (SELECT *, exp(log_evidence-max(log_evidence) OVER (PARTITION BY family)) AS ef, exp(log_evidence-max(log_evidence) OVER ()) AS eg FROM ev), po AS (SELECT model_id, family, prior_name, log_evidence, ef/sum(ef) OVER (PARTITION BY family) AS posterior_prob_family, eg/sum(eg) OVER () AS posterior_prob_global, row_number() OVER (PARTITION BY family ORDER BY log_evidence DESC, model_id) AS family_rank, row_number() OVER (ORDER BY log_evidence DESC, model_id) AS global_rank FROM ds)"
query("BAS_13_posteriors", sql(_POST + " SELECT *, family_rank=1 AS best_in_family, global_rank=1 AS best_global FROM po"), "log_evidence posterior_prob_family posterior_prob_global", "family_rank global_rank", digits=3)(lambda s, d: V.posteriors(V.evidence(A.snv(s, d))))
_BF = " SELECT {0} AS scope, {1} AS family, a.model_id AS better_model, b.model_id AS worse_model, a.log_evidence-b.log_evidence AS log_bayes_factor FROM po a JOIN po b ON {2}"
query("BAS_14_bayes_factors", sql(_POST + _BF.format("'family'", "a.family", "a.family=b.family AND a.family_rank<b.family_rank") + " UNION ALL" + _BF.format("'global'", "'ALL'", "a.global_rank<b.global_rank")), "log_bayes_factor", digits=3)(lambda s, d: V.bayes_factors(V.evidence(A.snv(s, d))).drop("bayes_factor"))
# Point predictions: posterior mean of the binomial model, its log score and errors
_PP = ", t AS (SELECT (1.0+sum(count)) AS a, (1.0+sum(coverage)-sum(count)) AS b FROM snv), pp AS (SELECT site_id, date, sample_id, mutation, count AS y, coverage AS n, a/(a+b) AS p, coverage*a/(a+b) AS y_hat, lgamma(coverage+1.0)-lgamma(count+1.0)-lgamma(coverage-count+1.0)+lgamma(count+a)+lgamma(coverage-count+b)-lgamma(coverage+a+b)-lgamma(a)-lgamma(b)+lgamma(a+b) AS logp FROM snv, t)"


def binomial_predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.snv(spark, sf_dir)
    t = x.agg((F.sum("count") + 1.0).alias("a"), (F.sum("coverage") - F.sum("count") + 1.0).alias("b"))
    y, n = F.col("count").cast("double"), F.col("coverage").cast("double")
    logp = S.log_choose(n, y) + S.betaln(y + F.col("a"), n - y + F.col("b")) - S.betaln(F.col("a"), F.col("b"))
    return x.crossJoin(F.broadcast(t)).select("site_id", "date", "sample_id", "mutation", F.col("count").alias("y"), F.col("coverage").alias("n"), (F.col("a") / (F.col("a") + F.col("b"))).alias("p"), (n * F.col("a") / (F.col("a") + F.col("b"))).alias("y_hat"), logp.alias("logp"))


query("BAS_06_predictive_logp", sql(_PP + " SELECT site_id, date, sample_id, mutation, y, n, p, y_hat, logp FROM pp"), "p y_hat logp", "y n", digits=3)(binomial_predictive)
query("BAS_11_predictive_metrics", sql(_PP + " SELECT sqrt(avg((y-y_hat)*(y-y_hat))) AS rmse_y, avg(abs(y-y_hat)) AS mae_y, sqrt(avg((y/greatest(n,1)-p)*(y/greatest(n,1)-p))) AS rmse_p, sum(logp) AS logp FROM pp"), "rmse_y mae_y rmse_p logp", digits=3)(lambda s, d: binomial_predictive(s, d).agg(M.rmse(F.col("y"), F.col("y_hat")).alias("rmse_y"), M.mae(F.col("y"), F.col("y_hat")).alias("mae_y"), M.rmse(F.col("y") / F.greatest("n", F.lit(1)), F.col("p")).alias("rmse_p"), F.sum("logp").alias("logp")))
query("FC_01_bb_logpmf", sql(", k AS (SELECT site_id, date, sample_id, mutation, count AS y, coverage AS n, af*0.9+0.02 AS mu, 50.0 AS phi FROM snv WHERE coverage>0) SELECT site_id, date, sample_id, mutation, lgamma(n+1.0)-lgamma(y+1.0)-lgamma(n-y+1.0)+lgamma(y+mu*phi)+lgamma(n-y+(1-mu)*phi)-lgamma(n+phi)-lgamma(mu*phi)-lgamma((1-mu)*phi)+lgamma(phi) AS logpmf FROM k"), "logpmf", digits=5)(lambda s, d: A.snv(s, d).filter("coverage > 0").withColumn("mu", F.col("af") * 0.9 + 0.02).select("site_id", "date", "sample_id", "mutation", S.betabinom_logpmf(F.col("count").cast("double"), F.col("coverage").cast("double"), F.col("mu") * 50.0, (1 - F.col("mu")) * 50.0).alias("logpmf")))
query("PRE_20_wilson_by_mutation", sql(", g AS (SELECT mutation, sum(count) AS y, sum(coverage)*1.0 AS n FROM snv GROUP BY 1) SELECT mutation, y/n AS p, greatest((y/n+1.9207294103470/n)/(1+3.8414588206941/n)-1.959963984540054*sqrt(y/n*(1-y/n)/n+3.8414588206941/(4*n*n))/(1+3.8414588206941/n),0) AS lo, least((y/n+1.9207294103470/n)/(1+3.8414588206941/n)+1.959963984540054*sqrt(y/n*(1-y/n)/n+3.8414588206941/(4*n*n))/(1+3.8414588206941/n),1) AS hi FROM g"), "p lo hi")(lambda s, d: A.snv(s, d).groupBy("mutation").agg(F.sum("count").alias("y"), (F.sum("coverage") * 1.0).alias("n")).select("mutation", P.wilson(F.col("y"), F.col("n")).alias("w")).select("mutation", "w.*"))
