"""The zero-inflated Beta-Binomial fit of one mutation's rows in plain NumPy, to compare the Spark aggregations with."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tributary.kernels.rw2 import Smooth, smooth
from tributary.kernels.special import bb_logpmf, bb_table, clip01
from tributary.kernels.zibb import distribution
from tributary.operators.mixture import Settings


@dataclass
class Fit:
    mu: np.ndarray
    kappa: np.ndarray
    pi: np.ndarray
    bins: np.ndarray
    edges: np.ndarray
    day: Smooth
    tables: dict = field(default_factory=dict)


def bin_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin i holds edges[i] < x <= edges[i + 1]; the end bins take what lies outside."""
    return np.searchsorted(edges[1:-1], x, side="left")


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit by the min-max formula over block means; for the few dozen bins of a calibrator."""
    cw, cy = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * y)])
    i, j = np.arange(len(y))[:, None], np.arange(len(y))[None, :]
    mean = np.where(i <= j, (cy[j + 1] - cy[i]) / np.maximum(cw[j + 1] - cw[i], 1e-12), np.inf)
    # row j, column k: mean of j .. k; smallest over k >= i, then largest over j <= i
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    return np.array([least[: k + 1, k].max() for k in range(len(y))])


def calibrator(mu: np.ndarray, y: np.ndarray, n: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Knots of a monotone map from fitted to observed rates; None for fewer than 50 rows or 3 populated bins."""
    if len(mu) < 50:
        return None
    edges = np.quantile(mu, np.linspace(0, 1, bins + 1))
    if len(np.unique(edges)) < 3:
        edges = np.linspace(0, 1, bins + 1)
    g = pd.DataFrame({"b": bin_of(mu, edges), "m": mu * np.maximum(n, 1), "w": np.maximum(n, 1), "y": y, "n": n}).groupby("b").sum()
    if len(g) < 3:
        return None
    x, w = (g["m"] / g["w"]).to_numpy(), np.maximum(g["n"].to_numpy(float), 1)
    order = np.argsort(x, kind="stable")
    fitted = isotonic((g["y"] / np.maximum(g["n"], 1)).to_numpy()[order], w[order])
    # equal neighbours are one block, placed at the plain mean of its bins
    block = np.concatenate([[0], np.cumsum(np.diff(fitted) > 1e-15)])
    knots = pd.DataFrame({"k": block, "x": x[order], "y": fitted}).groupby("k").agg({"x": "mean", "y": "last"})
    xs, ys = np.clip(knots["x"].to_numpy(), 0, 1), clip01(knots["y"].to_numpy())
    keep = np.concatenate([np.diff(xs) >= 1e-12, [True]])
    xs, ys = xs[keep], ys[keep]
    if xs[0] > 0:
        xs, ys = np.r_[0.0, xs], np.r_[ys[0], ys]
    if xs[-1] < 1:
        xs, ys = np.r_[xs, 1.0], np.r_[ys, ys[-1]]
    return xs, ys


def calibrated(mu: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    return clip01(mu) if knots is None else clip01(np.interp(mu, *knots))


def calibrated_day(s: Smooth, knots: tuple[np.ndarray, np.ndarray] | None, floor: np.ndarray) -> Smooth:
    """The daily fit through the map: variances on the logit scale by the delta method, band by the map itself."""
    mu = np.maximum(s.mu, floor)
    if knots is None:
        return Smooth(clip01(mu), s.var_a, clip01(s.lo), clip01(s.hi))
    xs, ys = knots
    k = np.clip(np.searchsorted(xs, mu, side="right") - 1, 0, len(xs) - 2)
    slope = (ys[k + 1] - ys[k]) / np.maximum(xs[k + 1] - xs[k], 1e-12)
    out = calibrated(mu, knots)
    jac = slope * mu * (1 - mu) / (out * (1 - out))
    return Smooth(out, s.var_a * jac * jac, calibrated(s.lo, knots), calibrated(s.hi, knots))


def adaptive_edges(mu: np.ndarray, bins: int, least: int) -> np.ndarray:
    """Quantile edges; the bin with the fewest rows is merged with its smaller neighbour until all have enough, or two are left.

    Rows are counted once; from then on a merge adds two counts.
    """
    cuts = np.unique(np.quantile(mu, np.linspace(0, 1, max(2, bins) + 1)))
    if len(cuts) == 1:
        return np.array([0.0, 1.0])
    if len(cuts) == 2:
        cuts = np.linspace(*cuts, 3)
    count = np.bincount(bin_of(mu, cuts), minlength=len(cuts) - 1).tolist()
    cuts = cuts.tolist()
    while len(count) > 2 and (fewest := min(count)) < max(1, least):
        k = count.index(fewest)
        sides = [j for j in (k - 1, k + 1) if 0 <= j < len(count)]
        i = min(k, min(sides, key=count.__getitem__))
        count[i : i + 2] = [count[i] + count[i + 1]]
        del cuts[i + 1]
    return np.array(cuts)


def bin_kappas(mu: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, edges: np.ndarray, s: Settings) -> np.ndarray:
    """Concentration of each bin by weighted moments; kappa_hi where rows or spread don't tell."""
    mu, n = clip01(mu), np.maximum(n, 1)
    p, at = y / n, bin_of(mu, edges)
    out = np.full(len(edges) - 1, s.kappa_hi)
    for b in range(len(out)):
        m = at == b
        total = w[m].sum()
        if m.sum() < 5 or total <= 0:
            continue
        pb = np.clip(p[m], *np.quantile(p[m], [s.winsor, 1 - s.winsor])) if m.sum() >= 20 else p[m]
        share = w[m] / total
        spread = share @ (pb - share @ pb) ** 2
        v = mu[m] * (1 - mu[m])
        excess = spread - share @ (v / n[m])
        if excess > 1e-12:
            out[b] = np.clip(share @ (v * (n[m] - 1) / n[m]) / excess - 1, s.kappa_lo, s.kappa_hi)
    return out


def kappa_at(mu: np.ndarray, edges: np.ndarray, kappas: np.ndarray) -> np.ndarray:
    return np.exp(np.interp(mu, (edges[:-1] + edges[1:]) / 2, np.log(np.maximum(kappas, 1e-12))))


def bin_pis(at: np.ndarray, r: np.ndarray, bins: int, least: int) -> np.ndarray:
    n, total = np.bincount(at, minlength=bins), np.bincount(at, weights=r, minlength=bins)
    return np.where(n >= least, np.clip((total + 0.5) / (n + 5.5), 0, 0.99), 0.0)


def fit(day: np.ndarray, days: int, y: np.ndarray, n: np.ndarray, s: Settings) -> Fit:
    """day: index of each row's date. Edges and calibrator are those of the first pass; later passes reweight rows by not being structural zeros."""
    y, n = np.asarray(y, float), np.maximum(np.asarray(n, float), 1)

    def pass_over(w: np.ndarray, knots, first: bool):
        total_n = np.bincount(day, w * n, days)
        raw = smooth(np.bincount(day, w * y, days), total_n if first else np.maximum(total_n, 1), s.penalty)
        rows = np.maximum(raw.mu[day], np.minimum(s.floor_c / n, s.floor_most))
        if first and s.calibrate:
            knots = calibrator(rows, y, n, s.bins)
        floor = np.minimum(s.floor_c / np.maximum(total_n, 1), s.floor_most)
        return calibrated(rows, knots), calibrated_day(raw, knots, floor), knots

    ones = np.ones(len(y))
    mu, daily, knots = pass_over(ones, None, True)
    edges = adaptive_edges(mu, s.bins, s.min_rows)
    bins = len(edges) - 1
    kappa = kappa_at(mu, edges, bin_kappas(mu, y, n, ones, edges, s))
    at = bin_of(mu, edges)
    pis = bin_pis(at, 0.25 * (y == 0), bins, s.min_rows)
    for _ in range(s.rounds):
        # a zero is structural with the odds of pi against a sampled zero
        odds = np.log(np.clip(pis[at], 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(pis[at], 1e-12, 1 - 1e-12)) - bb_logpmf(0, n, mu * kappa, (1 - mu) * kappa)
        r = np.where(y == 0, 1 / (1 + np.exp(-odds)), 0.0)
        mu, daily, _ = pass_over(1 - r, knots, False)
        kappa = kappa_at(mu, edges, bin_kappas(mu, y, n, 1 - r, edges, s))
        at = bin_of(mu, edges)
        pis = bin_pis(at, r, bins, s.min_rows)
    return Fit(mu, kappa, pis[at], at, edges, daily)


class Mixture:
    """Distribution functions of zero-inflated Beta-Binomials, each distinct (n, a, b) computed once while it is remembered."""

    def __init__(self, most: int = 20_000) -> None:
        self._most, self._tables = most, {}

    def table(self, n: int, a: float, b: float) -> np.ndarray:
        key = (n, a, b)
        if key not in self._tables:
            if len(self._tables) >= self._most:
                self._tables.clear()
            self._tables[key] = bb_table(n, a, b)
        return self._tables[key]

    def ppf(self, q: float, n: int, a: float, b: float, pi: float) -> int:
        return 0 if q <= pi else int(min(np.searchsorted(self.table(n, a, b), (q - pi) / (1 - pi), side="left"), n))

    def cdf(self, y: int, n: int, a: float, b: float, pi: float) -> float:
        return 0.0 if y < 0 else pi + (1 - pi) * float(self.table(n, a, b)[min(y, n)])


def widening(f: Fit, y: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Per bin the factor, 1 at least, by which the concentration is divided so that intervals cover their targets."""
    lo, hi = max(1.0, s.tau_bounds[0]), max(1.0, s.tau_bounds[0]) * 1.0001
    hi = max(hi, s.tau_bounds[1])
    out = np.ones(len(f.edges) - 1)
    for b in range(len(out)):
        m = f.bins == b
        if m.sum() < s.min_rows:
            continue

        def gap(tau: float, m=m) -> float:
            upto, below = distribution(y[m], n[m], f.mu[m], np.clip(f.kappa[m] / tau, 1e-12, 1e12), f.pi[m])
            # inside: not under the lower quantile, not over the upper one
            return min(1.0, *(float(np.mean((upto >= (1 - t) / 2) & (below < (1 + t) / 2))) - t for t in s.targets))

        if gap(lo) >= -s.tolerance:
            out[b] = lo
        elif gap(hi) <= -s.tolerance:
            out[b] = hi
        else:
            left, right = lo, hi
            for _ in range(s.tau_rounds):
                mid = np.sqrt(left * right)
                g = gap(mid)
                if abs(g) <= s.tolerance:
                    left = right = mid
                    break
                left, right = (mid, right) if g < 0 else (left, mid)
            out[b] = np.sqrt(left * right)
    return np.clip(out, lo, hi)
