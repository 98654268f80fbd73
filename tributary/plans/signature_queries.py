"""Queries over signatures, names, set operations and lineage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import sql
from ..functions.binning import digitize, quantile_edges
from ..operators import aa_naming as N
from ..operators import preprocess as P
from ..operators import shares as H
from ..operators import signatures as G
from ..registry import query

LINEAGES = ("L1", "L2", "L3", "L4")
_MATRIX = ", targets AS (SELECT DISTINCT mutation FROM snv), mapped AS (SELECT mutation, lineage, 1.0 AS weight FROM signatures WHERE mutation IN (SELECT mutation FROM targets)), rest AS (SELECT mutation, 'GLOBAL' AS lineage, 1.0 AS weight FROM targets WHERE mutation NOT IN (SELECT mutation FROM signatures))"


def matrix(spark: SparkSession, sf_dir: str, use_global: bool = False) -> DataFrame:
    return G.signature_matrix(G.normalized_signatures(A.signatures(spark, sf_dir)), A.snv_raw(spark, sf_dir), use_global)


query("SIG_01_normalized", sql("SELECT DISTINCT mutation, lineage, weight FROM signatures"), "weight")(lambda s, d: G.normalized_signatures(A.signatures(s, d).unionByName(A.signatures(s, d).select(F.concat(F.lit(" "), F.lower("mutation")).alias("mutation"), "lineage", "weight"))))
query("SIG_02_matrix_drop", sql(_MATRIX + " SELECT * FROM mapped"), "weight")(lambda s, d: matrix(s, d))
query("SIG_02_matrix_global", sql(_MATRIX + " SELECT * FROM mapped UNION ALL SELECT * FROM rest"), "weight")(lambda s, d: matrix(s, d, True))
query("JN_15_wide_matrix", sql(_MATRIX + " SELECT mutation, " + ", ".join(f"coalesce(max(weight) FILTER (WHERE lineage='{x}'),0) AS {x}" for x in LINEAGES) + " FROM mapped GROUP BY mutation"), " ".join(LINEAGES))(lambda s, d: G.wide_matrix(matrix(s, d), LINEAGES))
_OVERLAP = _MATRIX + ", n AS (SELECT lineage, sqrt(sum(weight*weight))+1e-9 AS norm FROM mapped GROUP BY 1), o AS (SELECT a.lineage AS l1, b.lineage AS l2, sum(a.weight*b.weight) AS dot FROM mapped a JOIN mapped b USING (mutation) GROUP BY ALL), c AS (SELECT x.lineage AS l1, y.lineage AS l2, CASE WHEN x.lineage=y.lineage THEN 1.0 ELSE least(greatest(coalesce(dot,0)/(x.norm*y.norm),0),1) END AS cosine FROM n x JOIN n y ON true LEFT JOIN o ON o.l1=x.lineage AND o.l2=y.lineage)"
query("SIG_03_overlap", sql(_OVERLAP + " SELECT * FROM c"), "cosine")(lambda s, d: G.overlap(matrix(s, d)))
# each lineage once more, without its first mutation
_TWINS = ", ends AS (SELECT lineage, min(mutation) AS first FROM mapped0 GROUP BY 1), mapped AS (SELECT * FROM mapped0 UNION ALL SELECT mutation, lineage||'b', weight FROM mapped0 JOIN ends USING (lineage) WHERE mutation<>first)"
query("SIG_04_near_duplicates", sql(_OVERLAP.replace("mapped AS", "mapped0 AS").replace("FROM mapped)", "FROM mapped0)").replace(", n AS (", _TWINS + ", n AS (") + " SELECT * FROM c WHERE l1<l2 AND cosine>0.9"), "cosine")(lambda s, d: G.near_duplicate_lineages(twins(matrix(s, d)), 0.9))


def twins(matrix: DataFrame) -> DataFrame:
    ends = matrix.groupBy("lineage").agg(F.min("mutation").alias("first"))
    return matrix.unionByName(matrix.join(ends, "lineage").filter("mutation <> first").select("mutation", F.concat("lineage", F.lit("b")).alias("lineage"), "weight"))


# largest eigenvalue of the Gram matrix by power steps, the smallest as what the largest of its complement leaves
_GRAM = _MATRIX + ", ls AS (SELECT DISTINCT lineage FROM mapped), gr AS (SELECT list(g ORDER BY l1) AS g FROM (SELECT l1, list(dot ORDER BY l2) AS g FROM (SELECT a.lineage AS l1, b.lineage AS l2, coalesce((SELECT sum(x.weight*y.weight) FROM mapped x JOIN mapped y USING (mutation) WHERE x.lineage=a.lineage AND y.lineage=b.lineage),0.0)::DOUBLE AS dot FROM ls a CROSS JOIN ls b) GROUP BY l1))"
_STEP = "list_dot_product(row, v) FOR row IN g"
_POWER = ", {p}(g, v, ev, i) AS (SELECT g, [1.0::DOUBLE/(k+1) FOR k IN range(1,len(g)+1)], 0.0::DOUBLE, 0 FROM {src} UNION ALL SELECT g, [x/sqrt(list_dot_product(w,w)) FOR x IN w], sqrt(list_dot_product(w,w)), i+1 FROM (SELECT g, i, [" + _STEP + "] AS w FROM {p}) WHERE i<3000)"
_CONDITION = _GRAM + _POWER.format(p="p1", src="gr") + ", top AS (SELECT g, ev AS l1 FROM p1 WHERE i=3000), comp AS (SELECT [[CASE WHEN r=c THEN l1 ELSE 0.0 END-g[r][c] FOR c IN range(1,len(g)+1)] FOR r IN range(1,len(g)+1)] AS g FROM top)" + _POWER.format(p="p2", src="comp")
query("SIG_05_condition", sql(_CONDITION + " SELECT (SELECT count(*) FROM ls) AS rank, sqrt(l1/(l1-ev)) AS condition FROM top, p2 WHERE i=3000").replace("WITH ", "WITH RECURSIVE ", 1), "condition", "rank", digits=4)(lambda s, d: s.createDataFrame([G.rank_and_condition(matrix(s, d))], "rank long, condition double"))
query("SIG_05_rank", sql(_MATRIX + " SELECT count(DISTINCT lineage) AS rank FROM mapped"), longs="rank")(lambda s, d: s.createDataFrame([(G.rank_and_condition(matrix(s, d))[0],)], "rank long"))


def wide_barcodes(long: DataFrame) -> DataFrame:
    """A 0/1 column for each mutation, a row for each lineage."""
    return long.select("lineage", "mutation").distinct().groupBy("lineage").pivot("mutation").agg(F.lit(1)).na.fill(0)


query("IO_08_barcodes", sql("SELECT DISTINCT lineage, mutation FROM signatures WHERE lineage IN ('L1','L3')"))(lambda s, d: G.barcodes(wide_barcodes(A.signatures(s, d)), "lineage", ["L1", "L3"]))
query("JN_14_missing_lineages", sql("SELECT lineage FROM (VALUES ('L1'),('L7'),('L3'),('L9')) w(lineage) WHERE lineage NOT IN (SELECT lineage FROM signatures)"))(lambda s, d: G.missing_lineages(wide_barcodes(A.signatures(s, d)), "lineage", ["L1", "L7", "L3", "L9"]))

# Names over a made-up genome: a repeated stretch with all codon classes in it.
_STRETCH = "ATGGCTTGGAACGTTAGCCATCAATTGTAAGCACCGGATTTC"
GENOME = (_STRETCH * 712)[:29903]
_ORF_SQL = "(VALUES " + ",".join(f"({i},'{n}',{a},{b})" for i, (n, a, b) in enumerate(N.ORFS)) + ") o(k, orf, l, r)"
_AA = lambda c: f"substr('{N.AMINO_ACIDS}', 16*(strpos('TCAG',substr({c},1,1))-1)+4*(strpos('TCAG',substr({c},2,1))-1)+strpos('TCAG',substr({c},3,1)), 1)"
def _named_sql(substitutions: str, keys: str = "") -> str:
    """Substitutions (keys, pos1, r, a) with aa_name and aa_status."""
    k = f"{keys}, " if keys else ""
    return f"""WITH {substitutions}, x AS (SELECT r||cast(pos1 AS varchar)||a AS mutation, *, CASE WHEN pos1>29903 THEN 'out_of_range' WHEN substr(g, cast(pos1 AS integer), 1)<>r THEN 'ref_mismatch' ELSE 'ok' END AS st FROM m, g),
 f AS (SELECT x.*, orf, l, row_number() OVER (PARTITION BY {k}mutation ORDER BY k) AS i FROM x LEFT JOIN {_ORF_SQL} ON pos1-1>=l AND pos1-1<r_ WHERE true),
 c AS (SELECT *, substr(g, cast(l+3*((pos1-1-l)//3)+1 AS integer), 3) AS codon, (pos1-1-l)%3 AS w FROM f WHERE i=1),
 q AS (SELECT *, substr(codon,1,cast(w AS integer))||a||substr(codon,cast(w+2 AS integer)) AS changed FROM c)
 SELECT {k}mutation, CASE WHEN st<>'ok' THEN NULL WHEN orf IS NULL OR {_AA('codon')}={_AA('changed')} THEN mutation ELSE 'aa:'||orf||':'||{_AA('codon')}||cast((pos1-1-l)//3+1 AS varchar)||{_AA('changed')} END AS aa_name, st AS aa_status FROM q""".replace("o(k, orf, l, r)", "o(k, orf, l, r_)")


def _substitution(key: Column) -> Column:
    """A substitution of the genome at a place that follows from a number."""
    at = key * 37
    return F.concat(F.substring(F.lit(GENOME), (at % 29903 + 1).cast("int"), F.lit(1)), at % 30100 + 1, F.substring(F.lit("ACGT"), (key % 4 + 1).cast("int"), F.lit(1)))


_SUBS = f"g AS (SELECT substr(repeat('{_STRETCH}',712),1,29903) AS g), m AS (SELECT DISTINCT {{keys}}({{n}}*37)%30100+1 AS pos1, substr(g, cast(({{n}}*37)%29903+1 AS integer), 1) AS r, substr('ACGT', cast({{n}}%4+1 AS integer), 1) AS a FROM part, g)"
query("SC_10_aa_names", _named_sql(_SUBS.format(keys="", n="p_partkey")))(lambda s, d: N.named_substitutions(A.table(s, d, "part").select(_substitution(F.col("p_partkey")).alias("mutation")).distinct(), GENOME))
# sizes as places, brands as lineages: barcodes of a few columns
query("SIG_06_named_barcodes", f"SELECT DISTINCT lineage, coalesce(aa_name, mutation) AS mutation FROM ({_named_sql(_SUBS.format(keys='p_brand AS lineage, ', n='(p_size*311)'), 'lineage')})")(
    lambda s, d: N.named_substitutions(G.barcodes(wide_barcodes(A.table(s, d, "part").select(F.col("p_brand").alias("lineage"), _substitution(F.col("p_size") * 311).alias("mutation"))), "lineage", [f"Brand#{k}" for k in range(1, 26)]), GENOME).select("lineage", F.coalesce("aa_name", "mutation").alias("mutation")).distinct()
)

_SCORES = ", sc AS (SELECT mutation, sum(coverage) AS coverage, avg(af) AS pred_af, median(af) AS mu, var_samp(af) AS leverage FROM snv GROUP BY mutation)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snv(spark, sf_dir).groupBy("mutation").agg(F.sum("coverage").alias("coverage"), F.avg("af").alias("pred_af"), F.median("af").alias("mu"), F.var_samp("af").alias("leverage"))


for _mode, _order in (("top_leverage", "round(leverage,12) DESC"), ("highest_coverage", "coverage DESC"), ("best_predicted", "round(abs(mu-pred_af),12)"), ("worst_predicted", "round(abs(mu-pred_af),12) DESC")):
    query(f"SIG_07_{_mode}", sql(_MATRIX + _SCORES + f" SELECT * FROM (SELECT lineage, mutation, row_number() OVER (PARTITION BY lineage ORDER BY {_order}, mutation) AS rank FROM mapped JOIN sc USING (mutation)) WHERE rank<=3"), longs="rank")(lambda s, d, m=_mode: G.selected_mutations(matrix(s, d), _scores(s, d).withColumns({"leverage": F.round("leverage", 12), "mu": F.round("mu", 12), "pred_af": F.round("pred_af", 12)}), m, 3))

# Compositions from the lineage index, renormalised: a stand-in for the solver's that SQL can state, too.
_THETA = ", w AS (SELECT site_id, date, mutation, sum(af*coverage)/greatest(sum(coverage),1) AS waf, sum(coverage) AS cov FROM snv GROUP BY ALL), ix AS (SELECT site_id, date, lineage, sum(weight*waf)/greatest(sum(weight),1) AS x FROM w JOIN signatures USING (mutation) GROUP BY ALL), ls AS (SELECT DISTINCT lineage FROM signatures), dd AS (SELECT site_id, date, sum(coverage) AS weight FROM snv GROUP BY ALL), th0 AS (SELECT dd.site_id, dd.date, ls.lineage, coalesce(x,0)+0.01 AS x, weight FROM dd CROSS JOIN ls LEFT JOIN ix USING (site_id, date, lineage)), theta AS (SELECT site_id, date, lineage, x/sum(x) OVER (PARTITION BY site_id, date) AS theta, weight, site_id||'__'||cast(date AS varchar) AS sample_id FROM th0)"


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    snv, sig = A.snv(spark, sf_dir), A.signatures(spark, sf_dir)
    each = P.daily_fraction(snv).join(sig, "mutation").groupBy("site_id", "date", "lineage").agg((F.sum(F.col("weight") * F.col("waf")) / F.greatest(F.sum("weight"), F.lit(1.0))).alias("x"))
    days = snv.groupBy("site_id", "date").agg(F.sum("coverage").alias("weight"))
    grid = days.crossJoin(F.broadcast(sig.select("lineage").distinct())).join(each, ["site_id", "date", "lineage"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)) + 0.01)
    return grid.select("site_id", "date", "lineage", (F.col("x") / F.sum("x").over(Window.partitionBy("site_id", "date"))).alias("theta"), "weight", F.concat_ws("__", "site_id", "date").alias("sample_id"))


query("SIG_08_default_site", sql("SELECT site_id, sum(coverage) AS total FROM snv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"), longs="total")(lambda s, d: G.default_site(A.snv(s, d)))
query("SIG_08_default_dates", sql(_THETA + ", h AS (SELECT site_id, date, sum(-theta*ln(theta)) AS entropy FROM theta GROUP BY ALL) SELECT site_id, date, entropy FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(entropy,12) DESC, date) AS r FROM h) WHERE r=1"), "entropy")(lambda s, d: G.default_dates(theta(s, d)))
_PRIORS = ", pr AS (SELECT mutation, sum(count)/sum(coverage) AS mu, 10.0+count(*) AS kappa FROM snv GROUP BY 1)"
_priors = lambda s, d: A.snv(s, d).groupBy("mutation").agg((F.sum("count") / F.sum("coverage")).alias("mu"), (F.count(F.lit(1)) + 10.0).alias("kappa"))
query("SIG_09_pseudo_counts", sql(_PRIORS + " SELECT mutation, mu*kappa AS a, (1-mu)*kappa AS b FROM pr"), "a b")(lambda s, d: G.pseudo_counts(_priors(s, d)))
query("SIG_09_density_curve", sql(_PRIORS + ", k AS (SELECT mutation, i, i/52 AS x, (mu*kappa-1)*ln(i/52)+((1-mu)*kappa-1)*ln(1-i/52) AS l FROM pr, (SELECT unnest(range(1,52)) AS i)) SELECT mutation, i, x, exp(l-max(l) OVER (PARTITION BY mutation)) AS y FROM k"), "x y", "i")(lambda s, d: G.density_curve(_priors(s, d)))
query("SIG_10_violations", "SELECT 0 AS off_simplex, 0 AS not_binary, 0 AS bad_mu, 0 AS bad_kappa", longs="off_simplex not_binary bad_mu bad_kappa")(lambda s, d: G.violations(theta(s, d), matrix(s, d), _priors(s, d)))

# Joins and set operations
query("JN_07_complete_grid", sql("SELECT site_id, date, coalesce(n,0) AS n FROM (SELECT DISTINCT site_id FROM snv) CROSS JOIN (SELECT DISTINCT date FROM snv) LEFT JOIN (SELECT site_id, date, count(*) AS n FROM snv WHERE mutation='CLICK:1' GROUP BY ALL) USING (site_id, date)"), longs="n")(lambda s, d: A.snv(s, d).transform(lambda x: x.select("site_id").distinct().crossJoin(F.broadcast(x.select("date").distinct())).join(x.filter("mutation = 'CLICK:1'").groupBy("site_id", "date").agg(F.count(F.lit(1)).alias("n")), ["site_id", "date"], "left").na.fill({"n": 0})))
query("JN_06_combine_first", sql("SELECT site_id, mutation, coalesce(a, b) AS v FROM (SELECT site_id, mutation, max(CASE WHEN count>=6 THEN af END) AS a FROM snv GROUP BY ALL) FULL JOIN (SELECT site_id, mutation, min(af) AS b FROM snv GROUP BY ALL) USING (site_id, mutation)"), "v")(lambda s, d: A.snv(s, d).transform(lambda x: x.groupBy("site_id", "mutation").agg(F.max(F.when(F.col("count") >= 6, F.col("af"))).alias("a")).join(x.groupBy("site_id", "mutation").agg(F.min("af").alias("b")), ["site_id", "mutation"], "full").select("site_id", "mutation", F.coalesce("a", "b").alias("v"))))
query("JN_08_target_reindex", sql("SELECT t.mutation, coalesce(sum(count),0) AS n FROM (SELECT DISTINCT upper(event_type)||':'||cast(i AS varchar) AS mutation FROM events, (SELECT unnest(range(12)) AS i)) t LEFT JOIN snv USING (mutation) GROUP BY 1"), longs="n")(lambda s, d: A.table(s, d, "events").select(F.upper("event_type").alias("e")).distinct().select("e", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select(F.concat_ws(":", "e", "i").alias("mutation")).join(A.snv(s, d), "mutation", "left").groupBy("mutation").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")))
query("JN_09_unmapped", sql("SELECT DISTINCT mutation FROM snv WHERE mutation NOT IN (SELECT mutation FROM signatures)"))(lambda s, d: A.snv(s, d).select("mutation").distinct().join(A.signatures(s, d), "mutation", "left_anti"))
query("JN_12_digitize", sql(", e AS (SELECT [quantile_cont(coverage,0.2),quantile_cont(coverage,0.4),quantile_cont(coverage,0.6),quantile_cont(coverage,0.8)] AS inn FROM snv) SELECT len(list_filter(inn, lambda x: x<coverage)) AS bin, count(*) AS n FROM snv, e GROUP BY 1"), longs="bin n")(lambda s, d: A.snv(s, d).crossJoin(F.broadcast(quantile_edges(A.snv(s, d), "coverage", 5))).groupBy(digitize(F.col("coverage"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
query("JN_16_keep_first", sql("SELECT site_id, mutation, date, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, mutation ORDER BY date, sample_id) AS r FROM snv) WHERE r=1"))(lambda s, d: A.snv(s, d).withColumn("r", F.row_number().over(Window.partitionBy("site_id", "mutation").orderBy("date", "sample_id"))).filter("r = 1").select("site_id", "mutation", "date", "sample_id"))

# Shares
query("NB_17_top_lineages", sql(_THETA + " SELECT lineage, sum(theta*greatest(weight,1))/sum(greatest(weight,1)) AS mean_theta FROM theta GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2"), "mean_theta")(lambda s, d: H.top_lineages(theta(s, d), 2))
query("NB_18_rolled_up", sql(_THETA + ", k AS (SELECT lineage FROM theta GROUP BY 1 ORDER BY sum(theta*greatest(weight,1))/sum(greatest(weight,1)) DESC, 1 LIMIT 2), g AS (SELECT site_id, date, sample_id, CASE WHEN lineage IN (SELECT lineage FROM k) THEN lineage ELSE 'Other' END AS lineage, sum(theta) AS theta FROM theta GROUP BY ALL) SELECT site_id, date, sample_id, lineage, theta/greatest(sum(theta) OVER (PARTITION BY site_id, date, sample_id),1e-12) AS theta FROM g"), "theta")(lambda s, d: H.rolled_up(theta(s, d), H.top_lineages(theta(s, d), 2)))
query("NB_19_wide_shares", sql(_THETA + ", n AS (SELECT site_id FROM theta GROUP BY 1 HAVING count(DISTINCT date)>=5) SELECT site_id, date, " + ", ".join(f"coalesce(max(theta) FILTER (WHERE lineage='{x}'),0) AS {x}" for x in LINEAGES) + " FROM theta WHERE site_id IN (SELECT site_id FROM n) GROUP BY site_id, date"), " ".join(LINEAGES))(lambda s, d: H.wide_shares(H.site_day_shares(theta(s, d)), LINEAGES))
query("NB_20_global_shares", sql(_THETA + " SELECT date, lineage, sum(theta*weight)/sum(weight) AS share FROM theta GROUP BY ALL"), "share")(lambda s, d: H.global_shares(H.site_day_shares(theta(s, d)), theta(s, d).select("site_id", "date", "weight").distinct()))
query("NB_20_last_composition", sql(_THETA + " SELECT site_id, date, lineage, theta AS share FROM (SELECT *, max(date) OVER (PARTITION BY site_id) AS last FROM theta) WHERE date=last"), "share")(lambda s, d: H.last_composition(H.site_day_shares(theta(s, d))))
query("NB_21_rolling_mean", sql(_THETA + " SELECT site_id, date, lineage, theta AS share, avg(theta) OVER (PARTITION BY site_id, lineage ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM theta"), "share smooth")(lambda s, d: H.rolling_mean(H.site_day_shares(theta(s, d))))
_GROW = _THETA + ", y AS (SELECT site_id, date, lineage, cast(date_diff('day', DATE '1970-01-01', date) AS integer) AS d, ln(theta/(1-theta)) AS y FROM theta), sl AS (SELECT site_id, date, lineage, CASE WHEN count(y) OVER w>=3 THEN covar_pop(y,d) OVER w/nullif(var_pop(d) OVER w,0) END AS slope FROM y WINDOW w AS (PARTITION BY site_id, lineage ORDER BY d RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))"
query("NB_22_23_growth", sql(_GROW + " SELECT site_id, date, lineage, slope, CASE WHEN slope>0 THEN least(ln(2)/slope,120) END AS doubling_days FROM sl"), "slope doubling_days", digits=5)(lambda s, d: H.growth(H.site_day_shares(theta(s, d))))
_PEAK = _THETA + ", pk AS (SELECT site_id, lineage, date AS peak_date, theta AS peak_share FROM (SELECT *, row_number() OVER (PARTITION BY site_id, lineage ORDER BY theta DESC, date) AS r FROM theta) WHERE r=1)"
query("NB_24_peaks", sql(_PEAK + " SELECT * FROM pk"), "peak_share")(lambda s, d: H.peaks(H.site_day_shares(theta(s, d))))
query("NB_24_peaks_by_month", sql(_PEAK + " SELECT lineage, strftime(peak_date,'%Y-%m') AS month, count(*) AS sites FROM pk GROUP BY ALL"), longs="sites")(lambda s, d: H.peaks_by_month(H.site_day_shares(theta(s, d))))
query("NB_25_change_correlation", sql(_THETA + ", de AS (SELECT site_id, date, lineage, theta-lag(theta) OVER (PARTITION BY site_id, lineage ORDER BY date) AS x FROM theta), r AS (SELECT a.site_id, a.lineage AS l1, b.lineage AS l2, corr(a.x,b.x) AS r FROM de a JOIN de b ON a.site_id=b.site_id AND a.date=b.date AND a.lineage<b.lineage WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL HAVING count(*)>=2) SELECT l1, l2, avg(r) AS mean_r FROM r GROUP BY ALL"), "mean_r")(lambda s, d: H.change_correlation(H.site_day_shares(theta(s, d))))
query("FC_18_turnover", sql(_THETA + ", q AS (SELECT *, lag(theta) OVER (PARTITION BY site_id, lineage ORDER BY date) AS q FROM theta) SELECT site_id, date, sum(-theta*ln(theta)) AS h, greatest(coalesce(sum((theta*ln(theta/((theta+q)/2))+q*ln(q/((theta+q)/2)))/2),0),0) AS jsd_prev FROM q GROUP BY ALL"), "h jsd_prev")(lambda s, d: H.turnover(theta(s, d)))
query("LIK_09_simplex_projection", sql(_THETA + ", v AS (SELECT site_id, date, lineage, theta*3-0.2 AS v FROM theta), j AS (SELECT *, row_number() OVER w AS j, sum(v) OVER w AS c FROM v WINDOW w AS (PARTITION BY site_id, date ORDER BY v DESC, lineage ROWS UNBOUNDED PRECEDING)), t AS (SELECT site_id, date, arg_max((c-1)/j, j) FILTER (WHERE v*j>c-1) AS tau FROM j GROUP BY ALL), p AS (SELECT site_id, date, lineage, greatest(v-tau,0) AS p FROM v JOIN t USING (site_id, date)) SELECT site_id, date, lineage, p/sum(p) OVER (PARTITION BY site_id, date) AS projected FROM p"), "projected")(lambda s, d: H.simplex_projection(theta(s, d).withColumn("v", F.col("theta") * 3 - 0.2), ["site_id", "date"], "lineage", "v"))
