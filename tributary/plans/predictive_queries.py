"""Posterior predictives, scores and leaderboard of the baseline models, and summaries of given rows, with SQL that computes their values.

The SQL sums masses by the ratio of neighbours and integrates Student's density by Simpson's rule, so it shares no special function with the kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..operators import evidence as V
from ..operators import metrics
from ..operators import signatures as G
from ..registry import query
from . import models as M
from .model_queries import predictive
from .score_queries import _POST, pairs

_LEVELS = {"lo50": 0.25, "hi50": 0.75, "lo90": 0.05, "hi90": 0.95}


def simpson(f: str, end: str, steps: int) -> str:
    """SQL of the integral of f, an expression in $, from 0 to end; steps is even."""
    at = f.replace("$", f"(({end})*i/{steps})")
    return f"(({end})/{3 * steps}*list_sum(list_transform(range(0,{steps + 1}), lambda i: (CASE WHEN i IN (0,{steps}) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*{at})))"


def _rows(family: str, values: str) -> str:
    return " UNION ALL ".join(values.format(id=f"{f}:{p}", a=a, b=b) for f, p, a, b in V.MODELS if f == family)


_T = "exp(c-(nu+1)/2*ln(1+$*$/nu))"
_QUANTILES = ", ".join(f"cast(count(*) FILTER (cdf<{x}) AS double) AS {name}" for name, x in _LEVELS.items())
_STUDENT = ", ".join(f"hat+scale*max(x) FILTER (p={x}) AS {name}" for name, x in _LEVELS.items())
_OUT = "model_id, y, rows, y_hat, logp, pit, lo50, hi50, lo90, hi90"
_PREDICTIVE = f"""{_POST}, pb AS (SELECT count AS y, coverage AS n, count(*) AS rows FROM snv GROUP BY ALL), px AS (SELECT cast(count>0 AS bigint) AS y, 1 AS n, count(*) AS rows FROM snv GROUP BY ALL), pc AS (SELECT count AS y, count(*) AS rows FROM snv GROUP BY 1),
 bm AS ({_rows('binomial', "SELECT '{id}' AS model_id, n, {a}+sy AS a, {b}+sn-sy AS b FROM (SELECT DISTINCT n FROM pb), (SELECT sy, sn FROM st)")} UNION ALL {_rows('bernoulli', "SELECT '{id}', 1, {a}+sx, {b}+n-sx FROM st")}),
 bk AS (SELECT model_id, n, a, b, unnest(generate_series(0,n)) AS k FROM bm),
 bl AS (SELECT *, sum(CASE WHEN k=0 THEN 0 ELSE ln((n-k+1.0)/k*(k-1+a)/(n-k+b)) END) OVER (PARTITION BY model_id, n ORDER BY k) AS l FROM bk),
 bs AS (SELECT *, exp(l-max(l) OVER (PARTITION BY model_id, n)) AS m FROM bl),
 bc AS (SELECT model_id, n, a, b, k, m/sum(m) OVER g AS mass, sum(m) OVER (g ORDER BY k)/sum(m) OVER g AS cdf FROM bs WINDOW g AS (PARTITION BY model_id, n)),
 bq AS (SELECT model_id, n, {_QUANTILES} FROM bc GROUP BY ALL),
 bt AS (SELECT model_id, n, k, n*a/(a+b) AS y_hat, ln(mass) AS logp, (cdf+lag(cdf,1,cdf) OVER (PARTITION BY model_id, n ORDER BY k))/2 AS pit FROM bc),
 py AS (SELECT 'binomial' AS family, y, n, rows FROM pb UNION ALL SELECT 'bernoulli', y, n, rows FROM px),
 beta AS (SELECT {_OUT} FROM py JOIN bt USING (n) JOIN bq USING (model_id, n) WHERE k=y AND starts_with(model_id, family||':')),
 pm AS ({_rows('poisson', "SELECT '{id}' AS model_id, {a}+sy AS r, ({b}+n)/({b}+n+1) AS p, ({a}+sy)/({b}+n) AS y_hat FROM st")}),
 pk AS (SELECT *, unnest(generate_series(0, cast(floor(greatest((SELECT max(y) FROM pc), y_hat+40*sqrt(y_hat+1))) AS bigint))) AS k FROM pm),
 pl AS (SELECT *, sum(CASE WHEN k=0 THEN r*ln(p) ELSE ln((k-1+r)/k*(1-p)) END) OVER (PARTITION BY model_id ORDER BY k) AS logp FROM pk),
 pd AS (SELECT model_id, k, y_hat, logp, least(1, sum(exp(logp)) OVER (PARTITION BY model_id ORDER BY k)) AS cdf FROM pl),
 pq AS (SELECT model_id, {_QUANTILES} FROM pd GROUP BY 1),
 pt AS (SELECT *, (cdf+lag(cdf,1,cdf) OVER (PARTITION BY model_id ORDER BY k))/2 AS pit FROM pd),
 poisson AS (SELECT {_OUT} FROM pc JOIN pt ON k=y JOIN pq USING (model_id)),
 ga AS ({_rows('gaussian', "SELECT '{id}' AS model_id, {a}+n AS kn, {b}+n/2 AS an, greatest(1e-12, v*greatest(1.0,{b}-1))+sse/2 AS bn, sy/n AS hat FROM st")}),
 gs AS (SELECT model_id, hat, 2*an AS nu, sqrt(bn*(kn+1)/(an*kn)) AS scale, lgamma(an+0.5)-lgamma(an)-0.5*ln(2*an*pi()) AS c FROM ga),
 gn(model_id, hat, nu, scale, c, p, x, i) AS (SELECT gs.*, p, cast(x AS double), 0 FROM gs, (VALUES (0.25,-0.674),(0.75,0.674),(0.05,-1.645),(0.95,1.645)) s(p, x)
  UNION ALL SELECT model_id, hat, nu, scale, c, p, x-(0.5+{simpson(_T, 'x', 400)}-p)/{_T.replace('$', 'x')}, i+1 FROM gn WHERE i<5),
 gq AS (SELECT model_id, {_STUDENT} FROM gn WHERE i=5 GROUP BY model_id, hat, scale),
 gz AS (SELECT *, (y-hat)/scale AS z FROM gs, pc),
 gt AS (SELECT model_id, y, rows, hat AS y_hat, c-(nu+1)/2*ln(1+z*z/nu)-ln(scale) AS logp, 0.5+{simpson(_T, 'z', 2000)} AS pit FROM gz),
 pr AS (SELECT {_OUT} FROM beta UNION ALL SELECT {_OUT} FROM poisson UNION ALL SELECT {_OUT} FROM gt JOIN gq USING (model_id))"""



def recursive(body: str) -> str:
    return sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


_SUMMARY = "sum(rows) AS n_rows, " + ", ".join(f"sum(rows*{c})/sum(rows) AS {c}" for c in ("y_hat", "logp", "pit", *_LEVELS)) + ", sum(rows*pit*pit)/sum(rows) AS pit2"
_SCORES = """, ks AS (SELECT model_id, max(greatest(cum/total-pit, pit-(cum-k)/total)) AS ks_distance FROM (SELECT model_id, pit, k, sum(k) OVER (PARTITION BY model_id ORDER BY pit) AS cum, sum(k) OVER (PARTITION BY model_id) AS total FROM (SELECT model_id, pit, sum(rows) AS k FROM (SELECT model_id, rows, round(pit,9) AS pit FROM pr) GROUP BY ALL)) GROUP BY 1),
 sc AS (SELECT model_id, sum(rows) AS n_rows, sqrt(sum(rows*(y-y_hat)*(y-y_hat))/sum(rows)) AS rmse_y, sum(rows*abs(y-y_hat))/sum(rows) AS mae_y, sum(rows*logp)/sum(rows) AS logp,
  sum(rows*cast(y BETWEEN lo50 AND hi50 AS integer))/sum(rows) AS coverage_50, sum(rows*cast(y BETWEEN lo90 AND hi90 AS integer))/sum(rows) AS coverage_90, 12*(sum(rows*pit*pit)/sum(rows)-power(sum(rows*pit)/sum(rows),2)) AS pit_var_ratio FROM pr GROUP BY 1)"""
_SCORE_COLUMNS = "rmse_y mae_y logp coverage_50 coverage_90 pit_var_ratio ks_distance"


def parts(table: DataFrame) -> DataFrame:
    """Means over rows by model and remainder of the count."""
    w = F.col("rows")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    g = table.groupBy("model_id", (F.col("y") % 8).alias("part"))
    return g.agg(F.sum(w).alias("n_rows"), *(mean(F.col(c)).alias(c) for c in ("y_hat", "logp", "pit", *_LEVELS)), mean(F.col("pit") * F.col("pit")).alias("pit2"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log scores as means, which don't grow with the table."""
    return M.predictive_scores(predictive(spark, sf_dir)).withColumn("logp", F.col("logp") / F.col("n_rows"))


query("BAS_06_09_predictive_values", recursive(_PREDICTIVE + f" SELECT model_id, y%8 AS part, {_SUMMARY} FROM pr GROUP BY ALL"), "y_hat logp pit lo50 hi50 lo90 hi90 pit2", "part n_rows", digits=4)(lambda s, d: parts(predictive(s, d)))
query("BAS_11_scores", recursive(_PREDICTIVE + _SCORES + " SELECT * FROM sc JOIN ks USING (model_id)"), _SCORE_COLUMNS, "n_rows", digits=4)(scores)
query("BAS_12_pit_histogram", recursive(_PREDICTIVE + " SELECT model_id, least(floor(pit*20),19) AS bin, sum(rows) AS n FROM pr GROUP BY ALL"), longs="bin n")(lambda s, d: M.pit_histogram(predictive(s, d)))
query("BAS_15_leaderboard", recursive(_PREDICTIVE + _SCORES + " SELECT po.*, family_rank=1 AS best_in_family, global_rank=1 AS best_global, n_rows, " + _SCORE_COLUMNS.replace(" ", ", ") + " FROM po LEFT JOIN sc USING (model_id) LEFT JOIN ks USING (model_id)"), "log_evidence posterior_prob_family posterior_prob_global " + _SCORE_COLUMNS, "family_rank global_rank n_rows", digits=3)(
    lambda s, d: V.posteriors(V.evidence(A.snv(s, d))).join(scores(s, d), "model_id", "left")
)

# E|Z - z| = sqrt(2 / pi) + 2 * integral from 0 to z of (z - t) * phi(t)
_GAP = simpson("(z-$)*exp(-$*$/2)/sqrt(2*pi())", "z", 200)
query("MET_05_crps_normal", f"SELECT doc_id, sigma*(sqrt(2/pi())+2*{_GAP}-1/sqrt(pi())) AS crps FROM (SELECT doc_id, sigma, (y-p)/sigma AS z FROM (SELECT doc_id, cast(quality AS double) AS y, ((doc_id*7919)%1000+0.5)/1000 AS p, 0.5+(1.0+doc_id%5)/10 AS sigma FROM labels))", "crps")(
    lambda s, d: pairs(s, d).select("doc_id", metrics.crps_normal(F.col("y"), F.col("p"), F.lit(0.5) + F.col("w") / 10).alias("crps"))
)


def observed_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rows in place of fitted ones, for summaries that SQL can follow."""
    return A.snv(spark, sf_dir).select(F.lit("row").alias("kind"), "mutation", F.col("af").alias("mu_t"), (F.col("coverage") + 5.0).alias("kappa_t"))


_HYPER = ", hp AS (SELECT mutation, median(af) AS mu, median(coverage+5.0) AS kappa FROM snv GROUP BY 1)"
_AB = ", ab AS (SELECT ln(m/(1-m)) AS a, ln(kappa) AS b FROM (SELECT least(greatest(mu,1e-12),1-1e-12) AS m, kappa FROM hp))"
query("PRI_18_observed_medians", sql(_HYPER + " SELECT mutation, mu, kappa, mu*kappa AS alpha, (1-mu)*kappa AS beta FROM hp"), "mu kappa alpha beta")(lambda s, d: M.hyperparameters(observed_detail(s, d)))
query("PRI_20_observed_population", sql(_HYPER + _AB + ' SELECT avg(a) AS m_a, avg(b) AS m_b, var_samp(a) AS "Saa", covar_samp(a,b) AS "Sab", var_samp(b) AS "Sbb" FROM ab'), "m_a m_b Saa Sab Sbb")(lambda s, d: M.population_prior(M.hyperparameters(observed_detail(s, d))))

# Observed fractions as shares, weights and rates: rows that break each rule, and rows that don't.
query("SIG_10_observed_violations", sql(", off AS (SELECT site_id, date FROM snv GROUP BY ALL HAVING abs(sum(af)-1)>1e-6) SELECT (SELECT count(*) FROM off) AS off_simplex, count(*) FILTER (af NOT IN (0,1)) AS not_binary, count(*) FILTER (NOT af*1.5-0.2 BETWEEN 0 AND 1) AS bad_mu, count(*) FILTER (count<3) AS bad_kappa FROM snv"), longs="off_simplex not_binary bad_mu bad_kappa")(
    lambda s, d: (lambda v: G.violations(v.select("site_id", "date", F.col("af").alias("theta")), v.select(F.col("af").alias("weight")), v.select((F.col("af") * 1.5 - 0.2).alias("mu"), (F.col("count") - 3).alias("kappa"))))(A.snv(s, d))
)
