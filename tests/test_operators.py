"""Small literal cases of the library's operators."""

from __future__ import annotations

import datetime
import types
import math

import pytest
from pyspark.sql import functions as F

from tributary.functions import scalars as S
from tributary.functions.binning import equal_bin, interpolate
from tributary.operators import aa_naming as N
from tributary.operators import diagnostics as D
from tributary.operators import metrics as M
from tributary.operators import preprocess as P
from tributary.operators import signatures as G
from tributary.plans import models, pipeline, priors
from tributary.sources import readers as R
from tributary.streaming.counts import daily_fractions

SIG = "mutation string, lineage string, weight double"


def pairs(df):
    return sorted((r.mutation, r.lineage) for r in df.collect())


def signatures(spark, rows):
    return spark.createDataFrame([(m, l, float(w)) for m, l, w in rows], SIG)


def targets(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "mutation string")


# signatures


def test_memberships_become_a_binary_table(spark):
    # every subset of three lineages is the membership of one mutation
    names = ["P", "Q", "R"]
    member = {f"M{k}": [x for i, x in enumerate(names) if k >> i & 1] for k in range(8)}
    s = G.normalized_signatures(signatures(spark, [(m, l, 1) for m, ls in member.items() for l in ls]))
    wide = {r.mutation: [x for x in names if r[x] == 1.0] for r in G.wide_matrix(G.signature_matrix(s, targets(spark, *member)), names).collect()}
    assert wide == {m: ls for m, ls in member.items() if ls}


def test_spellings_of_a_pair_are_one_and_blanks_are_none(spark):
    rows = [(spelt, "B.1", 1) for spelt in ("g55t", "G55T", "\tG55t ", " G55T")] + [("aa:orf8:l84s", " B.2\t", 1), ("  ", "B.1", 1), (None, "B.2", 1)]
    assert pairs(G.normalized_signatures(signatures(spark, rows))) == [("AA:ORF8:L84S", "B.2"), ("G55T", "B.1")]


def test_targets_without_lineage_are_left_out_or_global(spark):
    s, t = signatures(spark, [("G55T", "B.1", 1), ("T9C", "B.3", 1)]), targets(spark, "T77A", "G55T", "C8A")
    assert {use: pairs(G.signature_matrix(s, t, use)) for use in (False, True)} == {False: [("G55T", "B.1")], True: [("C8A", "GLOBAL"), ("G55T", "B.1"), ("T77A", "GLOBAL")]}


@pytest.mark.parametrize("weight", [0.25, 2.0, -1.0])
def test_other_weights_are_errors(spark, weight):
    with pytest.raises(Exception, match="weight must be 1"):
        G.normalized_signatures(signatures(spark, [("G55T", "B.1", 1), ("T9C", "B.1", weight)])).collect()


def test_a_table_without_lineages_is_an_error(spark):
    with pytest.raises(ValueError, match="lineage"):
        G.normalized_signatures(targets(spark, "G55T"))


def test_manual_selection(spark):
    m = signatures(spark, [("G55T", "B.2", 1), ("G55T", "B.1", 1), ("T9C", "B.3", 1)])
    assert [tuple(r) for r in G.selected_mutations(m, None, "manual", 0, [" t9c", "G55T"]).orderBy("rank").collect()] == [("B.3", "T9C", 1), ("B.1", "G55T", 2)]
    with pytest.raises(Exception, match="not in the signature matrix"):
        G.selected_mutations(m, None, "manual", 0, ["A1G"]).collect()


def test_rank_overlap_and_violations(spark):
    m = signatures(spark, [("A", "L1", 1), ("B", "L1", 1), ("A", "L2", 1), ("B", "L2", 1), ("C", "L3", 1)])
    assert G.rank_and_condition(m)[0] == 2 and [(r.l1, r.l2) for r in G.near_duplicate_lineages(m).collect()] == [("L1", "L2")]
    theta = spark.createDataFrame([("S", "d", "L1", 0.5), ("S", "d", "L2", 0.2), ("S", "e", "L1", 1.0)], "site_id string, date string, lineage string, theta double")
    priors = spark.createDataFrame([("A", 1.2, -1.0)], "mutation string, mu double, kappa double")
    assert tuple(G.violations(theta, m.unionByName(signatures(spark, [("D", "L1", 0.5)])), priors).first()) == (1, 1, 1, 1)


def test_barcodes(spark):
    wide = spark.createDataFrame([("L1", 1, 0), ("L2", 1, 1)], "lineage string, A1T int, C2G int")
    assert sorted(map(tuple, G.barcodes(wide, "lineage", ["L1", "L2"]).collect())) == [("L1", "A1T"), ("L2", "A1T"), ("L2", "C2G")]
    assert [r.lineage for r in G.missing_lineages(wide, "lineage", ["L1", "L9"]).collect()] == ["L9"]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        G.barcodes(wide.withColumn("C2G", F.lit(2)), "lineage", ["L1"]).collect()


@pytest.mark.parametrize(("mode", "want"), [("top_leverage", ["M2", "M1"]), ("highest_coverage", ["M3", "M1"]), ("best_predicted", ["M3", "M1"]), ("worst_predicted", ["M2", "M1"])])
def test_selection(spark, mode, want):
    scores = spark.createDataFrame([("M1", 0.2, 50, 0.5, 0.4), ("M2", 0.9, 10, 0.9, 0.1), ("M3", None, 80, 0.3, 0.3), ("M4", 1.0, 99, 0.0, 1.0)], "mutation string, leverage double, coverage long, mu double, pred_af double")
    m = signatures(spark, [("M1", "L1", 1), ("M2", "L1", 1), ("M3", "L1", 1)])
    assert [r.mutation for r in G.selected_mutations(m, scores, mode, 2).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        G.selected_mutations(m, scores, "other", 1)


def test_defaults_and_pseudo_counts(spark):
    cov = spark.createDataFrame([("A", 60), ("B", 20), ("B", 30)], "site_id string, coverage long")
    theta = spark.createDataFrame([("A", "2021-01-01", 0.98), ("A", "2021-01-01", 0.01), ("A", "2021-01-01", 0.01), ("A", "2021-01-02", 0.34), ("A", "2021-01-02", 0.33), ("A", "2021-01-02", 0.33)], "site_id string, date string, theta double")
    assert G.default_site(cov).first().site_id == "A" and G.default_dates(theta).first().date == "2021-01-02"
    a, b = G.pseudo_counts(spark.createDataFrame([("M", 0.44, 55.0)], "mutation string, mu double, kappa double")).select("a", "b").first()
    assert a == pytest.approx(24.2) and a + b == pytest.approx(55)


# names


def genome() -> str:
    return "A" * 29903


def test_amino_acid_names(spark):
    # all proline: the first place of a codon tells, the last one doesn't
    bases = "C" * 29903
    starts = {name: l for name, l, _ in N.ORFS}
    place = lambda orf, codon, k: starts[orf] + 3 * (codon - 1) + k + 1
    want = {f"C{place('N', 3, 0)}A": ("aa:N:P3T", "ok"), f"C{place('N', 3, 1)}T": ("aa:N:P3L", "ok"), f"C{place('S', 40, 0)}G": ("aa:S:P40A", "ok")}
    want |= {f"C{place('N', 3, 2)}T": (f"C{place('N', 3, 2)}T", "ok"), "C7G": ("C7G", "ok")}
    want |= {"T7G": (None, "ref_mismatch"), "ins:7:C": (None, "malformed"), "C29904T": (None, "out_of_range"), "C0T": (None, "out_of_range")}
    df = spark.createDataFrame([(n, 1) for n in want], "mutation string, codon int")
    assert {r.mutation: (r.aa_name, r.aa_status) for r in N.named_substitutions(df, bases).collect()} == want


def test_unknown_codon_keeps_the_nucleotide_name_and_first_frame_counts(spark):
    g = genome()
    g = g[:300] + "N" + g[301:13467] + "A" + g[13468:]
    df = targets(spark, "A300T", "A302T", "A13468T")
    got = {r.mutation: r.aa_name for r in N.named_substitutions(df, g).collect()}
    assert got["A13468T"].startswith("aa:orf1a:") and got["A300T"] == "A300T"


def test_codon_table(spark):
    t = dict(map(tuple, N.codon_table(spark).collect()))
    assert len(t) == 64 and t["ATG"] == "M" and t["TGG"] == "W" and [k for k, v in t.items() if v == "*"] == ["TAA", "TAG", "TGA"] and t["GCT"] == "A" and t["AAA"] == "K"


# reading and cleaning


def test_counts_are_coerced_and_added(spark, tmp_path):
    f = tmp_path / "raw.csv"
    f.write_text("sample_id,site_id,date,mutation,count,coverage\nu,S,2021-01-01, a1t ,3,10\nu,S,2021-01-01,A1T,9,5\n,S,2021-01-02,A->T*,x,-4\nu,S,bad,A1T,1,2\nu,S,2021-02-30,A1T,1,2\nu,,2021-01-03,A1T,2.0,4\n")
    got = sorted((r.site_id or "", str(r.date), r.sample_id, r.mutation, r["count"], r.coverage) for r in R.read_counts(spark, str(f)).collect())
    assert got == [("", "2021-01-03", "u", "A1T", 2, 4), ("S", "2021-01-01", "u", "A1T", 8, 15), ("S", "2021-01-02", "NA", "AT", 0, 0)]
    with pytest.raises(ValueError, match="coverage"):
        P.coerced_counts(spark.createDataFrame([(1,)], "site_id int"))
    assert R.count_and_size(R.read_counts(spark, str(f))) == ("count", "coverage")
    assert R.latest(spark, [str(tmp_path / "none*.csv"), str(tmp_path / "*.csv")]).endswith("raw.csv")


def test_strict_reader_fails_on_a_bad_date(spark, tmp_path):
    f = tmp_path / "snv.csv"
    f.write_text("sample,site,date,mutation,count,coverage\nu,S,2021-01-01,a1t*,3,10\n")
    r = R.read_snv_strict(spark, str(f)).first()
    assert (r.site_id, r.sample_id, r.mutation, str(r.date)) == ("S", "u", "A1T*", "2021-01-01")
    f.write_text("sample,site,date,mutation,count,coverage\nu,S,never,a1t,3,10\n")
    with pytest.raises(Exception, match="bad date"):
        R.read_snv_strict(spark, str(f)).collect()


def test_hyperparameter_reader(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("mutation,mu,kappa\n aa:m1 ,0.4,5\nM2,x,6\n")
    assert {r.mutation: (r.mu, r.kappa) for r in R.read_hyperparameters(spark, str(f)).collect()} == {"AA:M1": (0.4, 5.0), "M2": (None, 6.0)}
    for bad, why in (("mutation,mu,kappa\nM1,1,1\nmutation,mu,kappa\n", "header"), ("mutation,mu,kappa\nM1,1,1\nm1,2,2\n", "repeated mutation")):
        f.write_text(bad)
        with pytest.raises(Exception, match=why):
            R.read_hyperparameters(spark, str(f)).collect()


def test_writers_refuse_and_digest(spark, tmp_path):
    df = spark.range(10)
    R.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        R.write_table(df, str(tmp_path / "t"), overwrite=False)
    assert R.table_digest(df).first() == R.table_digest(df.orderBy(F.desc("id"))).first()
    (tmp_path / "g.fa").write_text(">one\nacgt\nAC\n>two\nGGG\n")
    assert N.read_fasta(spark, str(tmp_path / "g.fa")) == "ACGTAC"


def test_stop_codon_names_differ_by_canonicaliser(spark):
    r = spark.createDataFrame([("aa:orf8:Q27*",)], "m string").select(S.canonicalize_strict(F.col("m")).alias("a"), S.normalize_mutation(F.col("m")).alias("b")).first()
    assert (r.a, r.b) == ("AA:ORF8:Q27", "AA:ORF8:Q27*")


def test_overdispersion_recovers_concentration(spark):
    rows = [("S", datetime.date(2021, 1, 1), str(k), m, c, n) for m, vals in {"one": [(5, 10)], "none": [(0, 10), (0, 20)], "all": [(0, 10), (10, 10)], "flat": [(5, 10), (10, 20), (20, 40)]}.items() for k, (c, n) in enumerate(vals)]
    df = P.with_fractions(spark.createDataFrame(rows, "site_id string, date date, sample_id string, mutation string, count long, coverage long"))
    got = {r.mutation: (r.status, r.kappa) for r in P.overdispersion_moments(df).collect()}
    assert got["one"][0] == "insufficient" and got["none"][0] == "degenerate" and got["all"] == ("at_upper", 0.0) and got["flat"] == ("at_lower", 1e12)


# functions


def test_normal_functions(spark):
    z = [-8.0, -3.6, -1.0, 0.0, 0.5, 3.4, 6.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert all(g == pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), rel=1e-10, abs=1e-15) for g, v in zip(got, z, strict=True))
    p = spark.createDataFrame([(0.975,), (0.001,), (0.5,), (0.0,)], "p double").select(S.normal_ppf(F.col("p"))).collect()
    assert p[0][0] == pytest.approx(1.959963984540054, rel=1e-7) and p[1][0] == pytest.approx(-3.090232306167814, rel=1e-7) and abs(p[2][0]) < 1e-9 and p[3][0] is None


def test_bins_and_interpolation(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(equal_bin(F.col("x"), 0.0, 1.0, 4)).collect()] == [None, 0, 2, 3, None]
    knots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (1.0, 3.0))))
    assert [r[0] for r in df.select(interpolate(F.col("x"), knots)).collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 0.0, 3.0), (None, 0.5, 9.0)], "y double, p double, w double")
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    r = df.agg(M.rmse(y, p), M.mae(y, p, w)).first()
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] == pytest.approx(0.25)
    n = 20_000
    draws = spark.range(n).select(F.lit(0).alias("k"), S.normal_ppf((F.col("id") + 0.5) / n).alias("x"), F.lit(0.3).alias("y"))
    closed = spark.range(1).select(M.crps_normal(F.lit(0.3), F.lit(0.0), F.lit(1.0))).first()[0]
    assert M.crps_samples(draws, ["k"], "x", "y").first().crps == pytest.approx(closed, abs=1e-3)
    with pytest.raises(ValueError):
        M.calibration_bins(df, "y", "p", strategy="other")


def test_sample_and_curve(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("s"), "id")
    a = D.proportional_sample(df, "s", ["id"], 100)
    assert a.count() == 100 and sorted(a.collect()) == sorted(D.proportional_sample(df.repartition(7), "s", ["id"], 100).collect())
    perfect = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, 0.8)], "y double, p double")
    assert D.curve_areas(D.threshold_curve(perfect, "y", "p")).first().roc_auc == pytest.approx(1.0)


# stages


def test_stage_selection():
    assert pipeline.selected_stages(None) == ["preprocessing", "priors", "likelihood", "baseline"] and pipeline.selected_stages(["Evidence", "prep", "prep"]) == ["preprocessing", "baseline"]
    with pytest.raises(ValueError):
        pipeline.selected_stages(["none"])


def test_pipeline_end_to_end(spark):
    from tributary import adapters as A
    from tributary.kernels import particles

    sf = "/root/testdata/sf0.001"
    out = pipeline.run(A.snv_raw(spark, sf), A.signatures(spark, sf), ["preprocessing", "priors", "likelihood", "baseline", "forecast"], priors.Settings(rounds=2), None, particles.Settings(particles=32, draws=20, cap=16))
    assert out["coverage_summary"].count() > 0 and out["bayes_factors_full"].count() > 0
    total = out["theta_estimates"].groupBy("site_id", "date").agg(F.sum("theta").alias("t")).agg(F.max(F.abs(F.col("t") - 1))).first()[0]
    assert total < 1e-9 and out["residuals"].filter("z is null").count() == 0 and out["forecast"].filter("kind = 'next_share'").count() > 0


def test_missing_priors_are_neutral(spark):
    h = spark.createDataFrame([("A", 0.2, None, 3.0, 7.0), ("A", 0.3, 4.0, None, None)], "mutation string, mu double, kappa double, alpha double, beta double")
    got = {r.mutation: (r.mu, r.kappa) for r in models.resolved_priors(h, targets(spark, "A", "B")).collect()}
    assert got == {"A": (0.3, 4.0), "B": (0.5, 0.0)}


def test_stream_of_counts(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("S", "a1t", 3, 10, datetime.datetime(2021, 1, 1, 5)), ("S", "A1T", 9, 5, datetime.datetime(2021, 1, 1, 7)), ("S", "A1T", 1, 2, datetime.datetime(2021, 1, 9))]
    spark.createDataFrame(rows, "site_id string, mutation string, count long, coverage long, ts timestamp").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("site_id string, mutation string, count long, coverage long, ts timestamp").parquet(str(src))
    q = daily_fractions(stream).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("daily").collect()
    assert len(got) == 1 and got[0]["count"] == 8 and got[0].coverage == 15


def test_priors_are_read_for_any_number_of_mutations(spark):
    names = [f"m{k:04d}" for k in range(5001)]
    matrix = spark.createDataFrame([(m, f"L{k % 2}") for k, m in enumerate(names)], "mutation string, lineage string")
    priors = spark.createDataFrame([(m, 0.25, 7.0) for m in names], "mutation string, mu double, kappa double")
    snv = spark.createDataFrame([("S1", datetime.date(2024, 1, 1), m, 1, 10) for m in names[:50]], "site_id string, date date, mutation string, count long, coverage long")
    out = models.site_shares(snv, matrix, priors).filter("kind = 'residual'").agg(F.count(F.lit(1)), F.min("kappa"), F.max("kappa")).first()
    assert tuple(out) == (5001, 7.0, 7.0)


def test_registered_model_queries_use_the_default_settings(monkeypatch):
    from tributary.plans import model_queries as Q

    asked = {}
    monkeypatch.setattr(Q.A, "snv", lambda *_: None)
    monkeypatch.setattr(Q, "matrix", lambda *_: None)
    monkeypatch.setattr(Q.M, "site_forecasts", lambda *a, **b: asked.update(forecast=(a[2:], b)))
    monkeypatch.setattr(Q.M, "prior_detail", lambda *a, **b: asked.update(priors=(a[1:], b)))
    Q.forecasts(None, "")
    Q.detail(types.SimpleNamespace(sparkContext=types.SimpleNamespace(applicationId="none")), "")
    Q._DETAILS.pop(("none", ""))
    assert asked == {"forecast": ((), {}), "priors": ((), {})}


def test_normal_approximations_are_near_the_exact_ones(spark):
    from tributary.kernels import special
    from tributary.operators import model_reports as R

    n, a, b = 4000, 300.0, 700.0
    table = special.bb_table(n, a, b)
    df = spark.createDataFrame([(float(y),) for y in (1000, 1150, 1200, 1300, 1450)], "y double")
    c = [F.lit(float(n)), F.lit(a), F.lit(b)]
    for r in df.select("y", R.bb_cdf_normal(F.col("y"), *c).alias("p"), R.bb_ppf_normal(0.9, *c).alias("q")).collect():
        assert abs(r.p - table[int(r.y)]) < 0.01 and abs(table[r.q] - 0.9) < 0.02


def test_forecasts_start_from_the_baseline_and_leave_out_what_is_not_wanted(spark):
    from tributary.kernels import particles

    days = [datetime.date(2024, 1, d) for d in range(1, 7)]
    snv = spark.createDataFrame([("A", d, "s", m, c, 400) for d in days for m, c in (("M1", 320), ("M2", 80))], "site_id string, date date, sample_id string, mutation string, count long, coverage long")
    m = signatures(spark, [("M1", "L1", 1), ("M2", "L2", 1)])
    base = spark.createDataFrame([("A", d, l, t) for d in days for l, t in (("L1", 0.8), ("L2", 0.2))], "site_id string, date date, lineage string, theta double")
    s = particles.Settings(particles=64, draws=50)
    all_of = models.site_forecasts(snv, m, 200.0, s, base).collect()
    some = models.site_forecasts(snv, m, 200.0, s, base, ("next_share", "delta_elpd")).collect()
    assert {r.kind for r in all_of} == set(models.FORECAST_KINDS) and {r.kind for r in some} == {"next_share", "delta_elpd"}
    assert sorted(map(str, some)) == sorted(str(r) for r in all_of if r.kind in ("next_share", "delta_elpd"))
    first = lambda rows: next(r.mean for r in rows if r.kind == "filtered" and r.lineage == "L1" and r.date == days[0])
    wrong = base.withColumn("theta", F.when(F.col("lineage") == "L1", 0.05).otherwise(0.95))
    assert abs(first(all_of) - 0.8) < 0.1 and first(models.site_forecasts(snv, m, 200.0, s, wrong).collect()) < 0.3
    value = {r.kind: r.value for r in all_of if r.kind in ("elpd", "delta_elpd")}
    import numpy as np

    from tributary.kernels import special

    plain = 6 * float(special.bb_logpmf(np.array([320, 80]), 400, 200 * np.array([0.8, 0.2]), 200 * np.array([0.2, 0.8])).sum())
    assert value["elpd"] - value["delta_elpd"] == pytest.approx(plain)
    priors = spark.createDataFrame([("M1", 500.0), ("M2", None)], "mutation string, phi double")
    assert models.site_forecasts(snv, m, priors, s, kinds=("elpd",)).count() == 1


def test_priors_of_many_mutations_change_the_shares(spark):
    from tributary.kernels import simplex

    names = [f"M{k:05d}" for k in range(5001)]
    m = spark.createDataFrame([(n, f"L{k % 2}", 1.0) for k, n in enumerate(names)], SIG)
    snv = spark.createDataFrame([("A", datetime.date(2024, 1, 1), "s", n, 5, 10) for n in names], "site_id string, date date, sample_id string, mutation string, count long, coverage long")
    share = lambda mu: next(r.theta for r in models.site_shares(snv, m, spark.createDataFrame([(n, mu if k % 2 else 1 - mu, 90.0) for k, n in enumerate(names)], "mutation string, mu double, kappa double"), simplex.Settings(robust=0)).filter("kind = 'theta' and lineage = 'L1'").collect())
    assert share(0.9) > 0.7 and share(0.1) < 0.3


def test_wilson_of_more_trials_than_a_long_can_square(spark):
    from tributary.operators.preprocess import wilson

    for n in (3_200_000_000, 40_000_000_000):
        w = spark.createDataFrame([(n // 4, n)], "y long, n long").select(wilson(F.col("y"), F.col("n")).alias("w")).first().w
        assert w.lo < 0.25 < w.hi and w.hi - w.lo == pytest.approx(2 * 1.959963984540054 * (0.1875 / n) ** 0.5, rel=1e-6)
