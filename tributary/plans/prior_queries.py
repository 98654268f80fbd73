"""Queries over the steps of the priors' fit, on rates that SQL can follow: the pooled rate of each day in place of the smoothed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..functions.binning import digitize
from ..operators import dated_priors as D
from ..operators import mixture as X
from ..registry import query
from . import models as M

S = X.Settings()


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with y, n and m: the day's pooled rate, floored as the fit does it."""
    snv = M.enough_dates(A.snv(spark, sf_dir))
    daily = snv.groupBy("mutation", "date").agg(((F.sum("count") + 0.5) / (F.sum(F.greatest("coverage", F.lit(1))) + 1)).alias("mu"))
    rows = snv.join(daily, ["mutation", "date"]).withColumns({"y": F.col("count").cast("double"), "n": F.greatest(F.col("coverage").cast("double"), F.lit(1.0))})
    return rows.select("site_id", "date", "sample_id", "mutation", "y", "n", X.floored(F.col("mu"), F.col("n"), S).alias("m"))


_RATED = """, ok AS (SELECT mutation FROM snv GROUP BY 1 HAVING count(DISTINCT date)>=3),
 daily AS (SELECT mutation, date, (sum(count)+0.5)/(sum(greatest(coverage,1))+1) AS mu FROM snv WHERE mutation IN (SELECT mutation FROM ok) GROUP BY ALL),
 rated AS (SELECT site_id, date, sample_id, mutation, count*1.0 AS y, greatest(coverage,1)*1.0 AS n, greatest(mu, least(7.0/greatest(coverage,1), 0.05)) AS m FROM snv JOIN daily USING (mutation, date))"""


def _levels(bins: int) -> str:
    return "[" + ",".join(repr(k / bins) for k in range(bins + 1)) + "]"


_BIN = "len([x FOR x IN edges[2:len(edges)-1] IF x < m])"
_KNOTS = f""", q AS (SELECT mutation, count(*) AS n_rows, quantile_cont(m, {_levels(S.bins)}) AS e FROM rated GROUP BY 1),
 ed AS (SELECT mutation, n_rows, CASE WHEN len(list_distinct(e))<3 THEN {_levels(S.bins)} ELSE e END AS edges FROM q),
 binned AS (SELECT mutation, {_BIN} AS b, sum(m*n)/sum(n) AS x, sum(y) AS t, sum(n) AS w FROM rated JOIN ed USING (mutation) GROUP BY ALL),
 good AS (SELECT mutation FROM binned JOIN ed USING (mutation) GROUP BY 1 HAVING max(n_rows)>=50 AND count(*)>=3),
 placed AS (SELECT *, row_number() OVER o AS i, sum(t) OVER o AS ct, sum(w) OVER o AS cw FROM binned WHERE mutation IN (SELECT mutation FROM good) WINDOW o AS (PARTITION BY mutation ORDER BY x, b)),
 means AS (SELECT a.mutation, a.i AS j, c.i AS k, (c.ct-(a.ct-a.t))/(c.cw-(a.cw-a.w)) AS mean FROM placed a JOIN placed c ON a.mutation=c.mutation AND a.i<=c.i),
 lows AS (SELECT p.mutation, p.i, s.j, min(s.mean) AS low FROM placed p JOIN means s ON p.mutation=s.mutation AND s.j<=p.i AND s.k>=p.i GROUP BY ALL),
 fit AS (SELECT mutation, i, max(low) AS y FROM lows GROUP BY ALL),
 steps AS (SELECT mutation, i, x, y, CASE WHEN y-lag(y) OVER (PARTITION BY mutation ORDER BY i)<=1e-15 THEN 0 ELSE 1 END AS new FROM fit JOIN placed USING (mutation, i)),
 blocks AS (SELECT mutation, blk, least(greatest(avg(x),0),1) AS x, least(greatest(arg_max(y,i),1e-12),1-1e-12) AS y FROM (SELECT *, sum(new) OVER (PARTITION BY mutation ORDER BY i) AS blk FROM steps) GROUP BY ALL),
 kept AS (SELECT mutation, x, y FROM (SELECT *, lead(x) OVER (PARTITION BY mutation ORDER BY blk) AS nx FROM blocks) WHERE nx IS NULL OR nx-x>=1e-12),
 knots AS (SELECT mutation, x, y FROM kept UNION ALL SELECT mutation, 0.0, arg_min(y,x) FROM kept GROUP BY 1 HAVING min(x)>0 UNION ALL SELECT mutation, 1.0, arg_max(y,x) FROM kept GROUP BY 1 HAVING max(x)<1)"""
query("PRI_05_06_calibrator_knots", sql(_RATED + _KNOTS + " SELECT * FROM knots"), "x y")(lambda s, d: X.calibrator(rated(s, d), S.bins).select("mutation", F.inline("knots")))

_SEGMENTS = ", seg AS (SELECT mutation, x AS x0, y AS y0, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM knots WINDOW o AS (PARTITION BY mutation ORDER BY x))"
# days off the knots, where the slope jumps
query("PRI_07_calibrated_days", sql(_RATED + _KNOTS + _SEGMENTS + """, d AS (SELECT mutation, date, greatest(mu, least(7.0/n, 0.05)) AS x, 0.04*n AS var_a FROM (SELECT mutation, date, 0.97*mu+0.003 AS mu, sum(n) AS n FROM rated JOIN daily USING (mutation, date) GROUP BY ALL)),
 o AS (SELECT mutation, date, x, var_a, y0+(x-x0)*(y1-y0)/(x1-x0) AS mu, (y1-y0)/(x1-x0) AS slope FROM d JOIN seg USING (mutation) WHERE x>=x0 AND x<x1)
 SELECT mutation, date, mu, var_a*pow(slope*x*(1-x)/(mu*(1-mu)),2) AS var_a FROM o"""), "mu var_a", digits=5)(
    lambda s, d: X.calibrated_daily(days_off_knots(s, d).join(X.calibrator(rated(s, d), S.bins).filter("knots is not null"), "mutation"), S).select("mutation", "date", "mu", "var_a")
)


def days_off_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = rated(spark, sf_dir).join(pooled(spark, sf_dir), ["mutation", "date"]).groupBy("mutation", "date").agg(F.sum("n").alias("n"), (0.97 * F.max("mu") + 0.003).alias("mu"))
    return daily.withColumns({"lo": F.col("mu"), "hi": F.col("mu"), "var_a": 0.04 * F.col("n")})


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv = M.enough_dates(A.snv(spark, sf_dir))
    return snv.groupBy("mutation", "date").agg(((F.sum("count") + 0.5) / (F.sum(F.greatest("coverage", F.lit(1))) + 1)).alias("mu"))


_MERGED = f""", q AS (SELECT mutation, list_sort(list_distinct(quantile_cont(m, {_levels(S.bins)}))) AS c FROM rated GROUP BY 1),
 cuts0 AS (SELECT mutation, CASE len(c) WHEN 1 THEN [0.0::DOUBLE,1.0::DOUBLE] WHEN 2 THEN [c[1],(c[1]+c[2])/2,c[2]] ELSE c END AS edges FROM q),
 counted AS (SELECT mutation, {_BIN} AS b, count(*) AS k FROM rated JOIN cuts0 USING (mutation) GROUP BY ALL),
 grid AS (SELECT mutation, edges, unnest(range(0,len(edges)-1)) AS b FROM cuts0),
 start AS (SELECT mutation, any_value(edges) AS cuts, list(coalesce(k,0) ORDER BY b) AS counts FROM grid LEFT JOIN counted USING (mutation, b) GROUP BY 1),
 st AS (SELECT mutation, cuts, counts FROM start UNION ALL
  SELECT mutation, list_concat(cuts[1:i], cuts[i+2:len(cuts)]), list_concat(list_concat(counts[1:i-1], [counts[i]+counts[i+1]]), counts[i+2:len(counts)])
  FROM (SELECT mutation, cuts, counts, CASE WHEN p=1 THEN 1 WHEN p=len(counts) THEN p-1 WHEN counts[p-1]<=counts[p+1] THEN p-1 ELSE p END AS i FROM (SELECT *, list_position(counts, list_min(counts)) AS p FROM st) WHERE len(counts)>2 AND list_min(counts)<{S.min_rows})),
 merged AS (SELECT mutation, cuts AS edges, counts FROM st WHERE len(counts)<=2 OR list_min(counts)>={S.min_rows})"""


def _recursive(body: str) -> str:
    return sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.adaptive_edges(rated(spark, sf_dir), S.bins, S.min_rows)


query("PRI_08_09_adaptive_edges", _recursive(_RATED + _MERGED + " SELECT mutation, unnest(range(0,len(edges))) AS i, unnest(edges) AS edge FROM merged"), "edge", "i")(
    lambda s, d: merged_edges(s, d).select("mutation", F.posexplode("edges").alias("i", "edge"))
)

# A fit with these edges, concentrations by bin and inflations by bin: the next responsibilities, and from them the next concentrations and inflations.
_GIVEN = f", given AS (SELECT mutation, edges, [10.0+5*b FOR b IN range(0,len(edges)-1)] AS kappas, [0.1+0.02*b FOR b IN range(0,len(edges)-1)] AS pis FROM merged), placed AS (SELECT *, {_BIN} AS b FROM rated JOIN given USING (mutation))"
_RESP = """, centred AS (SELECT *, [(edges[i]+edges[i+1])/2 FOR i IN range(1,len(edges))] AS c FROM placed),
 around AS (SELECT *, len([x FOR x IN c IF x <= m]) AS pos FROM centred),
 kap AS (SELECT *, CASE WHEN pos=0 THEN kappas[1] WHEN pos=len(c) THEN kappas[pos] ELSE exp(ln(kappas[pos])+(m-c[pos])*(ln(kappas[pos+1])-ln(kappas[pos]))/(c[pos+1]-c[pos])) END AS kappa FROM around),
 resp AS (SELECT *, CASE WHEN y=0 THEN 1/(1+exp(lgamma((1-m)*kappa+n)+lgamma(kappa)-lgamma(kappa+n)-lgamma((1-m)*kappa)-ln(pis[b+1]/(1-pis[b+1])))) ELSE 0.0 END AS r FROM kap)"""
_NEXT = f""", lim AS (SELECT mutation, b, count(*) AS k, quantile_cont(y/n, {S.winsor}) AS lo, quantile_cont(y/n, {1 - S.winsor}) AS hi FROM resp GROUP BY ALL),
 cl AS (SELECT mutation, b, k, 1-r AS w, r, m*(1-m) AS v, n, CASE WHEN k>=20 THEN least(greatest(y/n,lo),hi) ELSE y/n END AS p FROM resp JOIN lim USING (mutation, b)),
 mid AS (SELECT mutation, b, sum(w*p)/sum(w) AS centre FROM cl GROUP BY ALL),
 mo AS (SELECT mutation, b, max(k) AS k, sum(w) AS w, sum(r) AS r, sum(w*(p-centre)*(p-centre))/sum(w)-sum(w*v/n)/sum(w) AS excess, sum(w*v*(n-1)/n)/sum(w) AS most FROM cl JOIN mid USING (mutation, b) GROUP BY ALL)
 SELECT mutation, grid.b AS bin, CASE WHEN k>=5 AND w>0 AND excess>1e-12 THEN least(greatest(most/excess-1,{S.kappa_lo}),{S.kappa_hi}) ELSE {S.kappa_hi} END AS kappa, CASE WHEN k>={S.min_rows} THEN least(greatest((r+0.5)/(k+5.5),0),0.99) ELSE 0.0 END AS pi
 FROM (SELECT mutation, unnest(range(0,len(edges)-1)) AS b FROM given) grid LEFT JOIN mo USING (mutation, b)"""


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.sequence(F.lit(0), F.size("edges") - 2)
    return merged_edges(spark, sf_dir).select("mutation", "edges", F.transform(every, lambda b: 10.0 + 5 * b).alias("kappas"), F.transform(every, lambda b: 0.1 + 0.02 * b).alias("pis"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with r, the expectation under the given fit."""
    rows = rated(spark, sf_dir).join(given(spark, sf_dir), "mutation")
    kappa = X.kappa_at(F.col("m"), F.col("edges"), F.col("kappas"))
    pi = F.get("pis", digitize(F.col("m"), F.col("edges")))
    return rows.withColumn("r", X.responsibility(F.col("y"), F.col("n"), F.col("m"), kappa, pi)).drop("edges", "kappas", "pis")


query("PRI_11_13_responsibilities", _recursive(_RATED + _MERGED + _GIVEN + _RESP + " SELECT site_id, date, sample_id, mutation, r FROM resp"), "r")(lambda s, d: expected(s, d).select("site_id", "date", "sample_id", "mutation", "r"))
query("PRI_10_12_bin_parameters", _recursive(_RATED + _MERGED + _GIVEN + _RESP + _NEXT), "kappa pi", "bin", digits=5)(
    lambda s, d: X.bin_parameters(expected(s, d), given(s, d), S).select("mutation", F.posexplode(F.arrays_zip("kappas", "pis")).alias("bin", "b")).select("mutation", "bin", F.col("b.kappas").alias("kappa"), F.col("b.pis").alias("pi"))
)

# Dated priors: pooled rates of the days, without a rate where little was counted, without a concentration where coverage is small.


def dated(spark: SparkSession, sf_dir: str, by_site: bool = True) -> DataFrame:
    keys = (["site_id"] if by_site else []) + ["date", "mutation"]
    day = A.snv(spark, sf_dir).groupBy(*keys).agg(F.sum("count").alias("y"), F.sum("coverage").alias("n"))
    return D.dated_priors(day.select(*keys, F.when(F.col("y") > 2, F.col("y") / F.col("n")).alias("mu"), F.when(F.col("n") > 200, 1.0 + F.col("n")).alias("kappa_t")))


def base_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolved_priors(A.snv(spark, sf_dir).groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("mu"), F.lit(20.0).alias("kappa")), A.signatures(spark, sf_dir))


_BASE = ", base AS (SELECT DISTINCT mutation, least(greatest(coalesce(mu,0.5),1e-9),1-1e-9) AS mu0, CASE WHEN mu IS NULL THEN 0.0 ELSE 20.0 END AS k0 FROM signatures LEFT JOIN (SELECT mutation, sum(count)/sum(coverage) AS mu FROM snv GROUP BY 1) USING (mutation)), days AS (SELECT DISTINCT site_id, date FROM snv), grid AS (SELECT * FROM days CROSS JOIN base)"
_DATED = ", dated AS (SELECT {keys}, CASE WHEN sum(count)>2 THEN sum(count)/sum(coverage) END AS mu_t, CASE WHEN sum(coverage)>200 THEN 1.0+sum(coverage) END AS kappa_t FROM snv GROUP BY {keys})"
_PICK = " SELECT site_id, date, mutation, CASE WHEN mu_t IS NULL THEN mu0 ELSE least(greatest(mu_t,1e-9),1-1e-9) END AS mu, coalesce(kappa_t,k0) AS kappa, mu_t IS NOT NULL OR kappa_t IS NOT NULL AS own FROM "
query("IO_07_priors_of_the_day", sql(_BASE + _DATED.format(keys="site_id, date, mutation") + _PICK + "grid LEFT JOIN dated USING (site_id, date, mutation)"), "mu kappa")(lambda s, d: D.resolved_by_date(A.snv(s, d), base_priors(s, d), dated(s, d)))
query("IO_07_priors_by_date_alone", sql(_BASE + _DATED.format(keys="date, mutation") + _PICK + "grid LEFT JOIN dated USING (date, mutation)"), "mu kappa")(lambda s, d: D.resolved_by_date(A.snv(s, d), base_priors(s, d), dated(s, d, False)))
for _name, _keys, _site, _by in (("LIK_02_carried_priors", "site_id, date, mutation", " AND d.site_id=grid.site_id", True), ("LIK_02_priors_carried_by_date", "date, mutation", "", False)):
    _found = "(SELECT grid.*, " + ", ".join(f"(SELECT arg_max(d.{v},d.date) FROM dated d WHERE d.mutation=grid.mutation AND d.date<=grid.date AND d.{v} IS NOT NULL{_site}) AS {v}" for v in ("mu_t", "kappa_t")) + " FROM grid)"
    query(_name, sql(_BASE + _DATED.format(keys=_keys) + _PICK + _found), "mu kappa")(lambda s, d, by=_by: D.resolved_by_date(A.snv(s, d), base_priors(s, d), dated(s, d, by), carry=True))
# dated priors of the customers' segments; counts by nation are sites without any
_SITES = "WITH p AS (SELECT DISTINCT c_mktsegment AS site_id, o_orderdate::DATE AS date FROM orders JOIN customer ON o_custkey=c_custkey), c AS (SELECT DISTINCT n_name AS site_id, o_orderdate::DATE AS date FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey UNION SELECT c_mktsegment, DATE '1990-01-01' FROM customer)"
query("LIK_18_prior_only_days", _SITES + " SELECT * FROM p UNION ALL SELECT * FROM c WHERE site_id NOT IN (SELECT site_id FROM p)")(lambda s, d: D.prior_only_days(*sites(s, d)))


def sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date("o_orderdate").alias("date")
    counts = orders.select(F.col("n_name").alias("site_id"), day).unionByName(A.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("site_id"), F.lit("1990-01-01").cast("date").alias("date")))
    return counts, D.dated_priors(orders.select(F.col("c_mktsegment").alias("site_id"), day, F.col("o_orderstatus").alias("mutation"), F.lit(0.5).alias("mu")))

# The daily series of observed rates
_SERIES = ", d AS (SELECT mutation, date, (sum(count)+0.5)/(sum(greatest(coverage,1))+1) AS mu, sum(coverage)+5.0 AS kappa, count(DISTINCT site_id) AS n_sites FROM snv GROUP BY ALL)"
query("PRI_19_observed_series", sql(_SERIES + " SELECT 'GLOBAL' AS site_id, date, mutation, mu AS mu_t, 0.9*mu AS mu_lo, 1.1*mu AS mu_hi, kappa AS kappa_t, n_sites, ln(mu/(1-mu)) AS a_t, ln(kappa) AS b_t FROM d"), "mu_t mu_lo mu_hi kappa_t a_t b_t", "n_sites")(lambda s, d: M.global_series(observed_days(s, d), A.snv(s, d)))


def observed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = (F.sum("count") + 0.5) / (F.sum(F.greatest("coverage", F.lit(1))) + 1)
    g = A.snv(spark, sf_dir).groupBy("mutation", "date").agg(mu.alias("mu_t"), (F.sum("coverage") + 5.0).alias("kappa_t"))
    return g.select(F.lit("day").alias("kind"), F.lit("GLOBAL").alias("site_id"), "date", "mutation", "mu_t", (0.9 * F.col("mu_t")).alias("mu_lo"), (1.1 * F.col("mu_t")).alias("mu_hi"), "kappa_t")
