"""Queries of test statistics with their tail probabilities. The SQL adds up other series, or integrates by another rule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..functions import tails as T
from ..operators import diagnostics as D
from ..registry import query
from . import diagnostic_queries as Q
from . import models as M
from . import predictive_queries as P


def chi_sql(x: str, freedom: str) -> str:
    lower = f"list_sum([exp(-({x})/2+({freedom}/2.0+k)*ln(({x})/2)-lgamma({freedom}/2.0+k+1)) FOR k IN range(0,700)])"
    return f"(CASE WHEN {x}<=0 THEN 1.0 WHEN {x}>700 THEN 0.0 ELSE greatest(1-{lower},0) END)"


def ks_sql(d: str, n: str) -> str:
    return f"least(greatest(2*list_sum([(CASE WHEN k%2=1 THEN 1 ELSE -1 END)*exp(-2.0*k*k*({d})*({d})*({n})) FOR k IN range(1,1500)]),0),1)"


def cvm_sql(x: str) -> str:
    bessel = lambda k: f"(10.0/3000*list_sum([(CASE WHEN i IN (0,1000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*exp(-{(4 * k + 1) ** 2}/(16.0*({x}))*(1+cosh(i/100.0)))*cosh(i/400.0) FOR i IN range(0,1001)]))"
    terms = "+".join(f"{math.gamma(k + 0.5) / math.gamma(0.5) / math.factorial(k) * math.sqrt(4 * k + 1)!r}*{bessel(k)}" for k in range(12))
    return f"least(greatest(1-({terms})/(pi()*sqrt({x})),0),1)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") % 97 + 1) / 100).alias("d"), (F.col("doc_id") % 41 + 1).alias("n"))


_N = "WITH x AS (SELECT doc_id, (doc_id%97+1)/100.0 AS d, doc_id%41+1 AS n FROM labels)"
query("SF_10_kolmogorov_tail", f"{_N} SELECT doc_id, {ks_sql('d', 'n')} AS p FROM x", "p")(lambda s, d: _numbers(s, d).select("doc_id", T.kolmogorov_tail(F.col("d"), F.col("n")).alias("p")))
query("SF_11_chi_square_tail", f"{_N} SELECT doc_id, {chi_sql('(60.0*d)', 'n')} AS p FROM x", "p")(lambda s, d: _numbers(s, d).select("doc_id", T.chi_square_tail(60 * F.col("d"), F.col("n").cast("double")).alias("p")))
query("SF_12_cramer_von_mises_tail", f"{_N} SELECT doc_id, {cvm_sql('(d+0.02)')} AS p FROM x", "p")(lambda s, d: _numbers(s, d).select("doc_id", T.cramer_von_mises_tail(F.col("d") + 0.02).alias("p")))

_STATS = f"WITH u AS (SELECT {Q._U} AS u FROM documents), h AS (SELECT sum(k) AS n, sum(k*k)*20/sum(k)-sum(k) AS chi2 FROM (SELECT least(floor(u*20),19) AS b, count(*) AS k FROM u GROUP BY 1)), r AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM u), t AS (SELECT cast(any_value(n) AS double) AS m, sum(power(u-(2*i-1)/(2.0*n),2))+1/(12.0*any_value(n)) AS cvm, max(greatest(i/n-u, u-(i-1)/n)) AS ks FROM r)"
query("NB_05_uniformity_tests", f"{_STATS} SELECT n, chi2, {chi_sql('chi2', '19')} AS chi2_p, cvm, {cvm_sql('cvm')} AS cvm_p, ks, {ks_sql('ks', 'm')} AS ks_p FROM h, t", "chi2 chi2_p cvm cvm_p ks ks_p", "n", digits=5)(lambda s, d: D.uniformity_tests(Q._docs(s, d), "u"))
query("NB_06_ks_tails_by_source", f"WITH r AS (SELECT source, {Q._U} AS u, row_number() OVER (PARTITION BY source ORDER BY {Q._U}) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), t AS (SELECT source, max(n) AS n, max(greatest(i/n-u, u-(i-1)/n)) AS d FROM r GROUP BY 1 HAVING max(n)>=10) SELECT source, n, d, {ks_sql('d', 'n')} AS p FROM t", "d p", "n")(
    lambda s, d: D.ks_distance(Q._docs(s, d), "u", ["source"], 10).withColumn("p", T.kolmogorov_tail(F.col("d"), F.col("n")))
)

_MASS = "ln(CASE WHEN count=0 THEN pi+(1-pi)*exp(bb) ELSE (1-pi)*exp(bb) END)"
_BB = "lgamma(n+1)-lgamma(y+1)-lgamma(n-y+1)+lgamma(y+a)+lgamma(n-y+b)-lgamma(n+a+b)-lgamma(a)-lgamma(b)+lgamma(a+b)"
_K2 = f"""{Q._FIT}, w AS (SELECT *, least(greatest(mu_t,1e-12),1-1e-12)*kappa_t AS a, (1-least(greatest(mu_t,1e-12),1-1e-12))*kappa_t AS b, coverage*1.0 AS n, count*1.0 AS y, avg(z) OVER () AS mz FROM z),
 mo AS (SELECT count(*) AS c, avg(CASE WHEN coverage>0 THEN {_MASS.replace('bb', _BB)} END) AS mean_log_mass, avg(power(z-mz,3))/power(avg(power(z-mz,2)),1.5) AS g1, avg(power(z-mz,4))/power(avg(power(z-mz,2)),2) AS b2 FROM w),
 s AS (SELECT *, g1*sqrt((c+1.0)*(c+3)/(6.0*(c-2))) AS y1, 3.0*(c*c+27*c-70)*(c+1)*(c+3)/((c-2.0)*(c+5)*(c+7)*(c+9)) AS beta FROM mo),
 s2 AS (SELECT *, -1+sqrt(2*(beta-1)) AS ww FROM s),
 s3 AS (SELECT *, 1/sqrt(0.5*ln(ww))*ln(y1/sqrt(2/(ww-1))+sqrt(power(y1/sqrt(2/(ww-1)),2)+1)) AS z1, (b2-3.0*(c-1)/(c+1))/sqrt(24.0*c*(c-2)*(c-3)/((c+1.0)*(c+1)*(c+3)*(c+5))) AS x, 6.0*(c*c-5*c+2)/((c+7.0)*(c+9))*sqrt(6.0*(c+3)*(c+5)/(c*(c-2.0)*(c-3))) AS sb FROM s2),
 s4 AS (SELECT *, 6+8.0/sb*(2.0/sb+sqrt(1+4.0/(sb*sb))) AS aa FROM s3),
 s5 AS (SELECT *, 1+x*sqrt(2/(aa-4)) AS dn FROM s4),
 s6 AS (SELECT *, (1-2/(9*aa)-sign(dn)*power((1-2.0/aa)/abs(dn),1/3.0))/sqrt(2/(9*aa)) AS z2 FROM s5)
 SELECT c AS n, mean_log_mass, z1*z1+z2*z2 AS k2, exp(-(z1*z1+z2*z2)/2) AS k2_p FROM s6"""
query("NB_07_fit_tests", sql(_K2), "mean_log_mass k2 k2_p", "n", digits=4)(lambda s, d: D.fit_tests(Q.z(s, d)))

_LEVELS = {0.5: 0.6744897501960817, 0.6: 0.8416212335729143, 0.7: 1.0364333894937898, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}
_SIX = Q._FIT + ", b AS (" + " UNION ALL ".join(f"SELECT *, {t} AS nominal, mean_y-{z}*sqrt(var_y) AS lo, mean_y+{z}*sqrt(var_y) AS hi FROM z" for t, z in _LEVELS.items()) + "), g AS (SELECT nominal, " + Q._COVER + " FROM b GROUP BY nominal)"
_Z2 = "1.959963984540054*1.959963984540054"
query("NB_03_coverage_grid", sql(_SIX + f", w AS (SELECT *, (empirical+{_Z2}/(2*n))/(1+{_Z2}/n) AS c, 1.959963984540054*sqrt(empirical*(1-empirical)/n+{_Z2}/(4.0*n*n))/(1+{_Z2}/n) AS h FROM g) SELECT * EXCLUDE (c, h), greatest(c-h,0) AS ci_lo, least(c+h,1) AS ci_hi FROM w"), "nominal empirical bias miss_low miss_high width ci_lo ci_hi", "n", digits=4)(
    lambda s, d: (lambda x: D.coverage_table(x[0], "count", x[1]))(D.normal_bands(Q.z(s, d)))
)
query("BAS_11_uniformity", P.recursive(P._PREDICTIVE + P._SCORES + f", hb AS (SELECT model_id, least(floor(pit*20),19) AS bin, sum(rows) AS n FROM pr GROUP BY ALL), hh AS (SELECT model_id, sum(n) AS n_rows, sum(n*n)*20.0/sum(n)-sum(n) AS pit_chi2 FROM hb GROUP BY 1) SELECT model_id, n_rows, pit_chi2, {chi_sql('pit_chi2', '19')} AS pit_chi2_p, {ks_sql('ks_distance', 'n_rows')} AS pit_ks_p FROM hh JOIN ks USING (model_id)"), "pit_chi2 pit_chi2_p pit_ks_p", "n_rows", digits=4)(
    lambda s, d: M.predictive_uniformity(P.predictive(s, d))
)
