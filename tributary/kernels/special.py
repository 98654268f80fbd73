"""Special functions and discrete distributions in NumPy alone."""

from __future__ import annotations

import functools
import math

import numpy as np

EPS = 1e-12


def gammaln(x) -> np.ndarray:
    x = np.asarray(x, float)
    low = x < 8
    shift = np.where(low, x + 8, x)
    r = 1 / (shift * shift)
    series = 1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360)))))
    out = (shift - 0.5) * np.log(shift) - shift + 0.5 * math.log(2 * math.pi) + series / shift
    if low.any():
        v = np.where(low, x, 1.0)
        product = v.copy()
        for k in range(1, 8):
            product = product * (v + k)
        out = out - np.where(low, np.log(product), 0.0)
    return out


def digamma(x) -> np.ndarray:
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = out - np.where(low, 1 / np.where(low, x, 1.0), 0.0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def betaln(a, b) -> np.ndarray:
    return gammaln(a) + gammaln(b) - gammaln(np.asarray(a, float) + b)


def logsumexp(x, axis=None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis=axis) if axis is not None else out.reshape(())[()]


def expit(a) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(a, float) / 2))


def clip01(x, eps: float = EPS) -> np.ndarray:
    return np.clip(x, eps, 1 - eps)


def bb_logpmf(y, n, a, b) -> np.ndarray:
    """Beta-Binomial; for n = 0 the logarithm of 1 at y = 0, of 0 elsewhere."""
    y, n, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (y, n, a, b)))
    good = (y >= 0) & (y <= n)
    z = np.where(good, y, 0)
    out = gammaln(n + 1) - gammaln(z + 1) - gammaln(n - z + 1) + betaln(z + a, n - z + b) - betaln(a, b)
    return np.where(good, out, -np.inf)


def bb_table(n: int, a: float, b: float) -> np.ndarray:
    """Distribution function at 0 .. n, from logarithms of all masses, so that none underflows before it is scaled."""
    k = np.arange(1, n + 1)
    steps = np.log((n - k + 1) / k * (k - 1 + a) / (n - k + b))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    total = np.cumsum(mass)
    return total / total[-1]


def bb_tables(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """bb_table of one n for a batch of (a, b), a row for each."""
    k = np.arange(1, n + 1)
    a, b = (np.asarray(v, float)[:, None] for v in (a, b))
    logs = np.concatenate([np.zeros((len(a), 1)), np.cumsum(np.log((n - k + 1) / k * (k - 1 + a) / (n - k + b)), axis=1)], axis=1)
    total = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return total / total[:, -1:]


def gammaln_step(x, d) -> np.ndarray:
    """gammaln(x + d) - gammaln(x) for x of 8 or more and x + d too, without the cancellation of two large values."""
    z = x + d
    tail = lambda v: (1 / 12 - (r := 1 / (v * v)) * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360)))))) / v
    return (x - 0.5) * np.log1p(d / x) + d * np.log(z) - d + tail(z) - tail(x)


#: Nodes of one panel of a sum, and cells (nodes times distributions) that are in memory at once.
_NODES, _CELLS = 16, 500_000


@functools.cache
def sum_nodes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss nodes and weights for sums over 0 .. width - 1: exact for polynomials of degree 2 * _NODES - 1 (the nodes of discrete Chebyshev polynomials)."""
    if width <= _NODES:
        return np.arange(width, dtype=float), np.ones(width)
    k = np.arange(1.0, _NODES)
    side = np.sqrt(k * k * (float(width) ** 2 - k * k) / (4 * (4 * k * k - 1)))
    at, v = np.linalg.eigh(np.diag(side, 1) + np.diag(side, -1))
    return at + (width - 1) / 2, width * v[0] ** 2


def bb_upto(k: int, n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(Y <= k), P(Y = k)) of Beta-Binomials of one n, for a batch of (a, b). The cost doesn't grow with n beyond its logarithm.

    Masses are a smooth function of the count. They are added from the nearer end in panels that are no wider than their distance from that end and two standard deviations, each by
    its Gauss nodes. Below 60 standard deviations from the mean there is nothing to add. Shapes below 1 count as 1 in a deviation: their masses fall from the end at the pace of that shape.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if 2 * k > n:
        above, _ = bb_upto(n - k - 1, n, b, a) if k < n else (np.zeros(len(a)), None)
        return 1 - above, np.exp(bb_logmass(np.array([float(k)]), n, a, b))[:, 0]
    p = a / (a + b)
    sd = np.sqrt(n * p * (1 - p) * (n + a + b) / (1 + a + b))
    pace = np.sqrt(n * np.maximum(a, 1) * np.maximum(b, 1) / (a + b + 1) ** 2 * (n + a + b) / (1 + a + b))
    widest = max(float(2 * pace.min()), _NODES)
    at = max(0, int((n * p - 60 * sd).min()))
    nodes, weights = [], []
    while at <= k:
        most = min(widest, max(at, _NODES), k + 1 - at)
        width = min(int(most), _NODES) if most < 2 * _NODES else _NODES * 2 ** int(math.log2(most / _NODES))
        x, w = sum_nodes(width)
        nodes.append(at + x)
        weights.append(w)
        at += width
    x, w, upto = np.concatenate(nodes), np.concatenate(weights), np.zeros(len(a))
    some = max(1, _CELLS // max(len(a), 1))
    for i in range(0, len(x), some):
        upto += np.exp(bb_logmass(x[i : i + some], n, a, b)) @ w[i : i + some]
    return np.clip(upto, 0, 1), np.exp(bb_logmass(np.array([float(k)]), n, a, b))[:, 0]


def bb_logmass(y: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """bb_logpmf of counts in 0 .. n that need not be whole, a row for each (a, b), to more digits where n is large."""
    a, b = a[:, None], b[:, None]

    def step(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """gammaln(x + c) - gammaln(x + 1); c may be so small that c - 1 would lose it."""
        near = x < 8
        out = gammaln_step(np.where(near, 8.0, x) + 1, c - 1)
        if near.any():
            out[:, near] = gammaln(x[near] + c) - gammaln(x[near] + 1)
        return out

    return step(y, a) + step(n - y, b) - step(np.array([float(n)]), a + b) - betaln(a, b)


def zibb_logpmf(y, n, a, b, pi) -> np.ndarray:
    """Zero-inflated Beta-Binomial: a zero is structural with probability pi; log(pi + (1 - pi) p(0)) and log(1 - pi) + log p(y)."""
    y, pi = np.asarray(y, float), np.clip(np.asarray(pi, float), 0.0, 1.0)
    with np.errstate(divide="ignore"):
        rest = np.log1p(-pi) + bb_logpmf(y, n, a, b)
        return np.where(y == 0, np.logaddexp(np.log(pi), rest), rest)


def nb_logpmf(x, r: float, p: float) -> np.ndarray:
    x = np.asarray(x, float)
    return gammaln(x + r) - gammaln(r) - gammaln(x + 1) + r * math.log(p) + x * math.log1p(-p)


def nb_table(most: int, r: float, p: float) -> np.ndarray:
    return np.minimum(np.cumsum(np.exp(nb_logpmf(np.arange(most + 1), r, p))), 1.0)


def betainc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    out = np.where(swap, 1 - _beta_tail(b, a, np.where(swap, 1 - x, 0.5)), _beta_tail(a, b, np.where(swap, 0.5, x)))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _beta_tail(a: float, b: float, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    x = np.clip(x, tiny, 1 - 1e-16)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - betaln(a, b)) / a
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return front * h


def t_cdf(x, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - half, half)


def t_logpdf(x, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    return gammaln((df + 1) / 2) - gammaln(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)


def t_ppf(q: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if float(t_cdf(mid, df)) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def normal_cdf(x) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised; the survival function of a chi-square variable with k degrees at c is gammainc_upper(k / 2, c / 2)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def kolmogorov_sf(d: float, n: int) -> float:
    x = math.sqrt(n) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 1e-3 else 1.0
