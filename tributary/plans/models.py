"""The model stages as DataFrames: priors by mutation, shares and forecasts by site. Each group crosses to Python once, as Arrow batches.

A group is one site's sums, a row for each date and mutation. What can be said with columns (sums, caps, medians, scores) is said before or after
with columns; the fit of the priors has a module of its own (priors).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip01
from ..functions.tails import chi_square_tail, kolmogorov_tail
from ..kernels import particles, simplex, special
from ..operators.global_order import exact_quantiles
from . import priors

def enough_dates(snv: DataFrame, least: int = 3) -> DataFrame:
    """Rows of mutations seen on so many dates."""
    good = snv.groupBy("mutation").agg(F.count_distinct("date").alias("n")).filter(F.col("n") >= least)
    return snv.join(good, "mutation", "left_semi")


def capped_coverage(snv: DataFrame, quantile: float = 0.98) -> DataFrame:
    """Coverage of at least 1 and at most its overall quantile; counts aren't clipped again, so a count may exceed its coverage until export."""
    cap = max(math.floor(exact_quantiles(snv, "coverage", (quantile,))[0] or 1), 1)
    return snv.withColumn("coverage", F.least(F.greatest("coverage", F.lit(1)), F.lit(cap)))


def daily_smooth(snv: DataFrame, penalty: float = 10.0) -> DataFrame:
    """(mutation, date, y, n, mu, lo, hi, var_a): the smoothed daily rate, from sums made before the shuffle."""
    daily = snv.groupBy("mutation", "date").agg(F.sum("count").alias("y"), F.sum("coverage").alias("n"))
    return daily.join(priors.smoothed(daily, penalty).drop("n"), ["mutation", "date"])


def prior_detail(snv: DataFrame, settings: priors.Settings | None = None, min_dates: int = 3, cap_quantile: float = 0.98) -> DataFrame:
    """Row-level posteriors of every mutation (kind row), and its daily series (kind day, site GLOBAL; counts and intervals null there). Fits when called."""
    ready = capped_coverage(enough_dates(snv.select("site_id", "date", "sample_id", "mutation", "count", "coverage"), min_dates), cap_quantile)
    return priors.detail(ready, settings or priors.Settings())


def hyperparameters(detail: DataFrame) -> DataFrame:
    """Medians over a mutation's rows, as Beta parameters."""
    g = detail.filter("kind = 'row'").groupBy("mutation").agg(F.median("mu_t").alias("mu"), F.median("kappa_t").alias("kappa"))
    return g.withColumns({"alpha": F.col("mu") * F.col("kappa"), "beta": (1 - F.col("mu")) * F.col("kappa")})


def global_series(detail: DataFrame, snv: DataFrame) -> DataFrame:
    sites = snv.groupBy("mutation", "date").agg(F.count_distinct("site_id").alias("n_sites"))
    g = detail.filter("kind = 'day'").select("site_id", "date", "mutation", "mu_t", "mu_lo", "mu_hi", "kappa_t")
    return g.join(sites, ["mutation", "date"], "left").withColumns({"a_t": F.log(clip01(F.col("mu_t")) / (1 - clip01(F.col("mu_t")))), "b_t": F.log("kappa_t")})


def population_prior(hyper: DataFrame) -> DataFrame:
    """Mean and covariance over mutations of logit rate and log concentration; 1, 0, 1 where there are too few."""
    a, b = F.log(clip01(F.col("mu")) / (1 - clip01(F.col("mu")))), F.log("kappa")
    g = hyper.select(a.alias("a"), b.alias("b")).agg(F.avg("a").alias("m_a"), F.avg("b").alias("m_b"), F.var_samp("a").alias("Saa"), F.covar_samp("a", "b").alias("Sab"), F.var_samp("b").alias("Sbb"))
    return g.na.fill({"Saa": 1.0, "Sab": 0.0, "Sbb": 1.0})


def resolved_priors(hyper: DataFrame, mutations: DataFrame, scale: float = 1.0, cap: float = float("inf")) -> DataFrame:
    """(mutation, mu, kappa) for every wanted mutation: its best row, else rate 0.5 and no concentration.

    Rows are ranked by kappa_shrunk, then kappa, then alpha + beta, as far as there are such columns; rates and concentrations are taken in the same order.
    """
    from pyspark.sql import Window

    none = F.lit(None).cast("double")
    ms, m, ks, k, a, b = (F.col(c) if c in hyper.columns else none for c in ("mu_shrunk", "mu", "kappa_shrunk", "kappa", "alpha", "beta"))
    each = hyper.select("mutation", F.coalesce(ms, m, F.when(a + b > 0, a / (a + b)), F.lit(0.5)).alias("m"), F.coalesce(ks, k, F.greatest(a + b - 2, F.lit(0.0)), F.lit(0.0)).alias("k"), ks.alias("r1"), k.alias("r2"), (a + b).alias("r3"))
    order = [F.desc_nulls_last("r1"), F.desc_nulls_last("r2"), F.desc_nulls_last("r3"), "m"]
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("mutation").orderBy(*order))).filter("r = 1")
    return mutations.select("mutation").distinct().join(best, "mutation", "left").select("mutation", F.least(F.greatest(F.coalesce("m", F.lit(0.5)), F.lit(1e-9)), F.lit(1 - 1e-9)).alias("mu"), F.least(F.greatest(F.coalesce("k", F.lit(0.0)) * scale, F.lit(0.0)), F.lit(cap)).alias("kappa"))


def _matrix(matrix: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """The signature matrix on the driver: mutations times lineages, which the model bounds (dozens by a handful)."""
    rows = matrix.select("mutation", "lineage").distinct().collect()
    m, l = sorted({r.mutation for r in rows}), sorted({r.lineage for r in rows})
    S, row, col = np.zeros((len(m), len(l))), {x: i for i, x in enumerate(m)}, {x: i for i, x in enumerate(l)}
    for r in rows:
        S[row[r.mutation], col[r.lineage]] = 1.0
    return m, l, S


def _grid(g: pd.DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dates, counts, coverages) of a site: dates by mutations, absent cells 0."""
    wide = g.groupby(["date", "mutation"])[["count", "coverage"]].sum().unstack("mutation", fill_value=0)
    pick = lambda c: wide[c].reindex(columns=names, fill_value=0).to_numpy(float)
    return wide.index.to_numpy(), pick("count"), pick("coverage")


SHARES = "kind string, site_id string, date date, lineage string, mutation string, iter int, theta double, theta_sd double, obs_af double, pred_af double, coverage double, kappa double, leverage double, objective double"


def site_shares(snv: DataFrame, matrix: DataFrame, known_priors: DataFrame, settings: simplex.Settings | None = None, by_date: DataFrame | None = None, prior_only_days: DataFrame | None = None) -> DataFrame:
    """All outputs of the site solver as one tagged table: theta rows, residual rows and trace rows. Split it by `kind` after caching it.

    by_date: (site_id, date, mutation, mu, kappa) as operators.dated_priors.resolved_by_date gives it; where it has a row, that one holds instead of known_priors. With prior_only_days
    (site_id, date) the counts are left out: each day's counts are its priors', kappa * mu out of kappa.
    """
    s = settings or simplex.Settings()
    names, lineages, S = _matrix(matrix)
    # as many rows as the matrix, which is on the driver anyway
    known = {r.mutation: (r.mu, r.kappa) for r in known_priors.join(matrix.select("mutation").distinct(), "mutation", "left_semi").select("mutation", "mu", "kappa").collect()}
    base = [np.array([known.get(m, (0.5, 0.0))[k] for m in names]) for k in (0, 1)]
    unknown = lineages.index("GLOBAL") if "GLOBAL" in lineages else None
    alone = prior_only_days is not None

    def run(g: pd.DataFrame, own: pd.DataFrame | None = None) -> pd.DataFrame:
        columns = [c.split()[0] for c in SHARES.split(", ")]
        if not len(g):
            return pd.DataFrame(columns=columns)
        site = g["site_id"].iloc[0]
        dates, y, n = _grid(g, names)
        mu, kappa = (np.repeat(v[None], len(dates), axis=0) for v in base)
        if own is not None and len(own):
            for values, c in ((mu, "mu"), (kappa, "kappa")):
                wide = own.pivot_table(index="date", columns="mutation", values=c, aggfunc="first").reindex(index=dates, columns=names).to_numpy(float)
                values[:] = np.where(np.isnan(wide), values, wide)
        if alone:
            y, n, af = kappa * mu, kappa.copy(), mu
        else:
            n = np.minimum(n, np.quantile(n, s.cap_quantile, axis=1)[:, None])
            af = np.where(n > 0, y / np.maximum(n, 1), 0.0)
        out = simplex.solve(S, y, n, mu, kappa, s, unknown)
        theta = pd.DataFrame({"kind": "theta", "site_id": site, "date": np.repeat(dates, len(lineages)), "lineage": np.tile(lineages, len(dates)), "theta": out.theta.ravel(), "theta_sd": out.sd.ravel()})
        resid = pd.DataFrame({"kind": "residual", "site_id": site, "date": np.repeat(dates, len(names)), "mutation": np.tile(names, len(dates)), "obs_af": af.ravel(), "pred_af": np.clip(out.theta @ S.T, 1e-12, 1 - 1e-12).ravel(), "coverage": n.ravel(), "kappa": kappa.ravel(), "leverage": out.leverage.ravel()})
        trace = pd.DataFrame({"kind": "trace", "site_id": site, "iter": range(len(out.objective)), "objective": out.objective})
        both = pd.concat([theta, resid, trace], ignore_index=True)
        both["iter"] = both["iter"].astype("Int32")
        return both[columns]

    if alone:
        cells = prior_only_days.select("site_id", "date", F.lit(names[0] if names else "").alias("mutation"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("coverage")).distinct()
    else:
        wanted = snv.join(matrix, "mutation", "left_semi")
        cells = wanted.groupBy("site_id", "date", "mutation").agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))
    if by_date is None:
        return cells.groupBy("site_id").applyInPandas(lambda g: run(g), SHARES)
    # names of their own: by_date may come from the same rows as the cells
    own = by_date.select(*(F.col(c).alias(c) for c in ("site_id", "date", "mutation", "mu", "kappa")))
    return cells.groupBy("site_id").cogroup(own.groupBy("site_id")).applyInPandas(lambda g, p: run(g, p), SHARES)


def z_scores(residuals: DataFrame) -> DataFrame:
    p = F.least(F.greatest("pred_af", F.lit(1e-12)), F.lit(1 - 1e-12))
    n, k = F.greatest("coverage", F.lit(1.0)), F.greatest("kappa", F.lit(0.0))
    return residuals.withColumn("z", (F.col("obs_af") - p) / F.sqrt(F.greatest(p * (1 - p) * (n + k) / (n * (k + 1)), F.lit(1e-12))))


def calibrated_uncertainty(theta: DataFrame, residuals: DataFrame) -> DataFrame:
    """theta_sd widened by the robust spread of the day's z-scores, never narrowed."""
    phi = z_scores(residuals).groupBy("site_id", "date").agg(F.greatest(F.coalesce(F.median(F.abs("z")) / simplex.MAD, F.lit(1.0)), F.lit(1.0)).alias("phi"))
    return theta.join(phi, ["site_id", "date"], "left").withColumn("theta_sd", F.col("theta_sd") * F.sqrt(F.coalesce("phi", F.lit(1.0)))).drop("phi")


FORECAST = "kind string, site_id string, date date, lineage string, mutation string, mean double, median double, q05 double, q95 double, smooth double, value double, observed double"


FORECAST_KINDS = ("filtered", "next_share", "next_count", "ess", "loglik", "pit", "qq", "elpd", "delta_elpd")


def site_forecasts(snv: DataFrame, matrix: DataFrame, phi: float | DataFrame = 200.0, settings: particles.Settings | None = None, baseline: DataFrame | None = None, kinds: Sequence[str] = FORECAST_KINDS) -> DataFrame:
    """Tagged output of the particle filter of each site: rows of the wanted kinds; only what these need is computed.

    phi: one dispersion, or (mutation, phi) as operators.model_reports.dispersions gives it. baseline: (site_id, date, lineage, theta); the first date's shares, if it
    has all lineages, are where the particles start (else even shares), and delta_elpd is the gain over the log score of the baseline's shares. Each part draws from
    a stream of its own, so what is left out changes nothing else.
    """
    s, kinds = settings or particles.Settings(), frozenset(kinds)
    names, lineages, S = _matrix(matrix)
    if isinstance(phi, DataFrame):
        # as many rows as the matrix, which is on the driver anyway
        given = {r.mutation: r.phi for r in phi.filter("phi is not null").join(matrix.select("mutation").distinct(), "mutation", "left_semi").collect()}
        phis = np.maximum([given.get(m, 200.0) for m in names], 1.0)
    else:
        phis = np.full(len(names), max(phi, 1.0))
    even = np.full(len(lineages), 1 / len(lineages)) if lineages else np.empty(0)
    columns = [c.split()[0] for c in FORECAST.split(", ")]

    def shares_on(base: pd.DataFrame | None, dates: np.ndarray) -> list[np.ndarray | None]:
        """The baseline's shares of each date, scaled to 1; None where it has not all lineages."""
        if base is None or not len(base):
            return [None] * len(dates)
        wide = base.pivot_table(index="date", columns="lineage", values="theta", aggfunc="sum").reindex(index=dates, columns=lineages)
        return [None if np.isnan(x).any() or x.sum() <= 0 else x / x.sum() for x in wide.to_numpy(float)]

    def run(g: pd.DataFrame, base: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=columns)
        site = g["site_id"].iloc[0]
        stream = lambda part: particles.generator(s.seed, f"{site}/{part}")
        dates, y, n = _grid(g, names)
        known = shares_on(base, dates)
        start = even if known[0] is None else np.maximum(known[0], special.EPS)
        f = particles.run_filter(y, n, S, phis, start / start.sum(), s, particles.generator(s.seed, site))
        parts: list[dict] = []

        def add(kind: str, **values) -> None:
            parts.append({"kind": kind, "site_id": site, **values})

        def summary(kind: str, date, draws: np.ndarray, **values) -> None:
            q = np.quantile(draws, (0.05, 0.5, 0.95), axis=0)
            add(kind, date=date, mean=draws.mean(axis=0), q05=q[0], median=q[1], q95=q[2], **values)

        if "filtered" in kinds:
            medians = np.median(np.array(f.particles), axis=1)
            medians = medians / medians.sum(axis=1, keepdims=True)
            smoother = {"bss": lambda: particles.backward_path(f, s, stream("path")), "map": lambda: particles.most_probable_path(medians, y, n, S, phis, s)[0]}
            path = smoother.get(s.smoother, lambda: medians)()
            for t, date in enumerate(dates):
                summary("filtered", date, f.particles[t], lineage=lineages, smooth=path[t])
        for kind, values in (("ess", f.ess), ("loglik", f.evidence)):
            if kind in kinds:
                add(kind, date=dates, value=values)
        if "pit" in kinds:
            rng = stream("pit")
            for t, date in enumerate(dates):
                u = particles.pits(np.exp(f.log_w[t]), f.particles[t], y[t], n[t], S, phis, s, rng)
                if len(u):
                    add("pit", date=date, value=u)
        if "qq" in kinds:
            for t, date in enumerate(dates):
                add("qq", date=date, mutation=names, value=n[t] * np.clip(f.particles[t] @ S.T, 1e-12, 1).mean(axis=0), observed=y[t])
        if kinds & {"next_share", "next_count"}:
            shares, counts = particles.next_day(f, n, S, phis, s, stream("next"))
            after = (pd.Timestamp(dates[-1]) + pd.Timedelta(days=1)).date()
            for kind, draws, what in (("next_share", shares, {"lineage": lineages}), ("next_count", counts, {"mutation": names})):
                if kind in kinds:
                    summary(kind, after, draws, **what)
        if "elpd" in kinds:
            add("elpd", value=[f.elpd_waic])
        if "delta_elpd" in kinds and base is not None and len(base):
            add("delta_elpd", value=[f.elpd_waic - particles.plugin_log_score(y, n, S, phis, np.array([even if x is None else x for x in known]))])
        if not parts:
            return pd.DataFrame(columns=columns)
        out = pd.concat([pd.DataFrame(x) for x in parts], ignore_index=True).reindex(columns=columns)
        for c in ("date", "lineage", "mutation"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        return out

    wanted = snv.join(matrix, "mutation", "left_semi")
    # several samples of a day are added up, so a date has one value for each mutation
    cells = wanted.groupBy("site_id", "date", "mutation").agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))
    if baseline is None:
        return cells.groupBy("site_id").applyInPandas(lambda g: run(g), FORECAST)
    base = baseline.groupBy("site_id", "date", "lineage").agg(F.avg("theta").alias("theta"))
    return cells.groupBy("site_id").cogroup(base.groupBy("site_id")).applyInPandas(lambda g, b: run(g, b), FORECAST)


PREDICTIVE = "model_id string, y long, n long, rows long, p_mean double, y_hat double, logp double, pit double, lo50 double, hi50 double, lo90 double, hi90 double"


def predictive_tables(pairs: DataFrame, model_id: str, family: str, stats: dict[str, float], p1: float, p2: float) -> DataFrame:
    """Posterior predictive of one baseline model at each distinct (y, n): values repeat over rows, so each is computed once.

    pairs: y, n, rows. stats: one row of sufficient statistics (operators.evidence), on the driver.
    """

    def run(batches):
        for b in batches:
            all_y, all_n = b["y"].to_numpy(), b["n"].to_numpy()
            order = np.argsort(all_n, kind="stable")
            found = {c.split()[0]: np.full(len(b), np.nan) for c in PREDICTIVE.split(", ")[4:]}
            # one distribution table for each n of the batch
            for at in np.split(order, np.flatnonzero(np.diff(all_n[order])) + 1) if len(b) else ():
                y, n = all_y[at], int(all_n[at[0]])
                mean = np.nan
                if family in ("binomial", "bernoulli"):
                    hits, all_ = (stats["sy"], stats["sn"]) if family == "binomial" else (stats["sx"], stats["rows"])
                    a, c = p1 + hits, p2 + all_ - hits
                    cdf, mean = special.bb_table(n, a, c), a / (a + c)
                    logp, hat = special.bb_logpmf(y, n, a, c), n * mean
                elif family == "poisson":
                    r, rate = p1 + stats["sy"], p2 + stats["rows"]
                    hat, p = r / rate, rate / (rate + 1)
                    cdf, logp = special.nb_table(int(max(y.max(), hat + 40 * (hat + 1) ** 0.5)), r, p), special.nb_logpmf(y, r, p)
                if family == "gaussian":
                    kn, an = p1 + stats["rows"], p2 + stats["rows"] / 2
                    bn = max(1e-12, stats["var"] * max(1.0, p2 - 1)) + stats["sse"] / 2
                    hat, scale = stats["mean"], (bn * (kn + 1) / (an * kn)) ** 0.5
                    z = (y - hat) / scale
                    logp, pit = special.t_logpdf(z, 2 * an) - np.log(scale), special.t_cdf(z, 2 * an)
                    q = [hat + scale * special.t_ppf(x, 2 * an) for x in (0.25, 0.75, 0.05, 0.95)]
                else:
                    pit, q = 0.5 * (cdf[y] + cdf[np.maximum(y - 1, 0)]), np.searchsorted(cdf, (0.25, 0.75, 0.05, 0.95))
                for column, value in zip(found, (mean, hat, logp, special.clip01(pit), *q), strict=True):
                    found[column][at] = value
            yield pd.DataFrame({"model_id": [model_id] * len(b), "y": all_y, "n": all_n, "rows": b["rows"].to_numpy(), **found})

    return pairs.select("y", "n", "rows").mapInPandas(run, PREDICTIVE)


def predictive_scores(table: DataFrame) -> DataFrame:
    """Per model: errors, log score, coverage of both intervals, variance ratio and Kolmogorov distance of the integral transforms."""
    from pyspark.sql import Window

    w = F.col("rows")
    mean = lambda x: F.sum(w * x) / F.sum(w)
    inside = lambda lo, hi: ((F.col("y") >= F.col(lo)) & (F.col("y") <= F.col(hi))).cast("double")
    d = table.groupBy("model_id", "pit").agg(F.sum("rows").alias("k"))
    v = Window.partitionBy("model_id")
    d = d.withColumns({"cum": F.sum("k").over(v.orderBy("pit")), "all": F.sum("k").over(v)}).groupBy("model_id").agg(F.max(F.greatest(F.col("cum") / F.col("all") - F.col("pit"), F.col("pit") - (F.col("cum") - F.col("k")) / F.col("all"))).alias("ks_distance"))
    g = table.groupBy("model_id").agg(F.sum("rows").alias("n_rows"), F.sqrt(mean((F.col("y") - F.col("y_hat")) ** 2)).alias("rmse_y"), mean(F.abs(F.col("y") - F.col("y_hat"))).alias("mae_y"), F.sum(w * F.col("logp")).alias("logp"), mean(inside("lo50", "hi50")).alias("coverage_50"), mean(inside("lo90", "hi90")).alias("coverage_90"), ((mean(F.col("pit") * F.col("pit")) - mean(F.col("pit")) ** 2) * 12).alias("pit_var_ratio"))
    return g.join(d, "model_id")


def predictive_uniformity(table: DataFrame, bins: int = 20) -> DataFrame:
    """Per model: chi-square of the integral transforms over equal bins and their Kolmogorov distance, each with the chance of a larger one."""
    h = pit_histogram(table, bins).groupBy("model_id").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    chi2 = F.col("sq") * bins / F.col("n_rows") - F.col("n_rows")
    scored = h.join(predictive_scores(table).select("model_id", "ks_distance"), "model_id").withColumn("pit_chi2", chi2)
    return scored.select("model_id", "n_rows", "pit_chi2", chi_square_tail(F.col("pit_chi2"), F.lit(bins - 1.0)).alias("pit_chi2_p"), kolmogorov_tail(F.col("ks_distance"), F.col("n_rows")).alias("pit_ks_p"))


def pit_histogram(table: DataFrame, bins: int = 20) -> DataFrame:
    return table.groupBy("model_id", F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.sum("rows").alias("n"))
