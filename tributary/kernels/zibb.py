"""Quantiles and distribution functions of zero-inflated Beta-Binomials, for batches of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .special import bb_logpmf, bb_tables, clip01

#: Cells of distribution tables that are in memory at once, about.
CELLS = 2_000_000
#: Counts up to which a distribution is held as a table; beyond it the masses are added up piece by piece.
TABLE = 5_000
PIECE = 4_096


def streamed(n: int, a: np.ndarray, b: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Quantiles of Beta-Binomials of one n, a row for each (a, b) and its levels: masses are added up from 0 in pieces until all levels are reached.

    Memory doesn't grow with n. Where the masses before the bulk underflow they add nothing, as they should.
    """
    out, done, at = np.zeros(levels.shape, int), levels <= 0, 0
    total = np.zeros(len(a))
    while at <= n and not done.all():
        k = np.arange(at, min(at + PIECE, n + 1))
        upto = total[:, None] + np.cumsum(np.exp(bb_logpmf(k[None, :], n, a[:, None], b[:, None])), axis=1)
        for j in range(levels.shape[1]):
            below = (upto < levels[:, j, None]).sum(axis=1)
            reached = ~done[:, j] & (below < len(k))
            out[reached, j] = at + below[reached]
            done[:, j] |= reached
        total, at = upto[:, -1], at + len(k)
    out[~done] = n
    return out


def quantiles(n: np.ndarray, mu: np.ndarray, kappa: np.ndarray, pi: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """Quantiles of each row's mixture, a column for each level. Rows are taken by n, equal distributions once, in batches of about CELLS, whatever n."""
    n = np.asarray(n, int)
    out = np.zeros((len(n), len(levels)), int)
    a, b = mu * kappa, (1 - mu) * kappa
    order = np.lexsort((pi, b, a, n))
    for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        if not len(rows):
            continue
        k = int(n[rows[0]])
        keys = np.stack([a[rows], b[rows], pi[rows]], axis=1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        first, which = rows[new], np.cumsum(new) - 1
        got = np.zeros((len(first), len(levels)), int)
        step = max(1, CELLS // (min(k, PIECE if k > TABLE else k) + 1))
        for at in range(0, len(first), step):
            some = first[at : at + step]
            inners = [(q - pi[some]) / np.maximum(1 - pi[some], 1e-300) for q in levels]
            if k > TABLE:
                got[at : at + step] = np.where(np.array(levels) <= pi[some, None], 0, streamed(k, a[some], b[some], np.stack(inners, axis=1)))
                continue
            table = bb_tables(k, a[some], b[some])
            for j, (q, inner) in enumerate(zip(levels, inners, strict=True)):
                got[at : at + step, j] = np.where(q <= pi[some], 0, np.minimum((table < inner[:, None]).sum(axis=1), k))
        out[rows] = got[which]
    return out


def intervals(n: np.ndarray, mu: np.ndarray, kappa: np.ndarray, pi: np.ndarray, *targets: float) -> list[np.ndarray]:
    """lo and hi, one after the other, of each row's central intervals that should hold the targets."""
    levels = [x for t in targets for x in ((1 - t) / 2, (1 + t) / 2)]
    return list(quantiles(n, clip01(mu), np.clip(kappa, 1e-12, 1e12), pi, levels).T)


def distribution(y: np.ndarray, n: np.ndarray, mu: np.ndarray, kappa: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(Y <= y), P(Y < y)) of each row's mixture. Masses are added from the nearer end, rows of like length together, in batches of about CELLS."""
    m = clip01(mu)
    a, b, y, n = m * kappa, (1 - m) * kappa, np.asarray(y, int), np.asarray(n, int)
    far = 2 * y > n
    # from the other end, P(Y <= y) is what misses more than n - y leave, and P(Y < y) what n - y or more do
    k, a, b = np.where(far, n - y, y), np.where(far, b, a), np.where(far, a, b)
    first = bb_logpmf(0, n, a, b)
    upto, below = np.empty(len(y)), np.empty(len(y))
    order = np.argsort(k, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, CELLS // (int(k[order[min(len(order) - 1, at + 256)]]) + 1))
        rows = order[at : at + min(size, 256)]
        j = np.arange(1, int(k[rows[-1]]) + 1)
        x, z, w = (v[rows, None] for v in (a, b, n))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log(np.maximum(w - j + 1, 1e-300) / j * (x + j - 1) / np.maximum(w - j + z, 1e-300))
        mass = np.exp(first[rows, None] + np.concatenate([np.zeros((len(rows), 1)), np.cumsum(step, axis=1)], axis=1))
        total = np.cumsum(mass, axis=1)
        here, own = np.arange(len(rows)), k[rows]
        upto[rows], below[rows] = total[here, own], total[here, own] - mass[here, own]
        at += len(rows)
    upto, below = np.where(far, 1 - below, upto), np.where(far, 1 - upto, below)
    return clip01(pi + (1 - pi) * upto), np.where(y > 0, pi + (1 - pi) * below, 0.0)
