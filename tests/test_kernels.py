"""Kernels against independent computations and properties."""

from __future__ import annotations

import itertools
import math

import brute_zibb as plain
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.kernels import particles, rw2, simplex, special, zibb


def test_special_functions():
    x = np.concatenate([np.logspace(-6, 7, 200), [1, 2, 7.999, 8]])
    assert np.max(np.abs(special.gammaln(x) - [math.lgamma(v) for v in x]) / np.maximum(1, np.abs([math.lgamma(v) for v in x]))) < 1e-13
    h = 1e-5
    assert np.allclose(special.digamma(np.array([0.3, 1.0, 4.5, 30.0])), (special.gammaln(np.array([0.3, 1, 4.5, 30]) + h) - special.gammaln(np.array([0.3, 1, 4.5, 30]) - h)) / (2 * h), atol=1e-7)
    assert float(special.t_cdf(1.0, 1.0)) == pytest.approx(0.75, abs=1e-12) and special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert special.gammainc_upper(1.0, 2.0) == pytest.approx(math.exp(-2)) and float(special.normal_cdf(1.959963984540054)) == pytest.approx(0.975)
    assert special.kolmogorov_sf(0.0, 10) == 1.0 and special.kolmogorov_sf(1.36 / 10, 100) == pytest.approx(0.0491, abs=1e-3)


@given(st.integers(0, 60), st.floats(0.05, 50), st.floats(0.05, 50), st.floats(0.001, 0.999))
@settings(max_examples=60, deadline=None)
def test_bb_table_and_quantiles(n, a, b, q):
    t = special.bb_table(n, a, b)
    assert np.allclose(t, np.cumsum(np.exp(special.bb_logpmf(np.arange(n + 1), n, a, b))), atol=1e-9)
    m = plain.Mixture()
    k = m.ppf(q, n, a, b, 0.0)
    assert m.cdf(k, n, a, b, 0.0) >= q - 1e-12 and (k == 0 or m.cdf(k - 1, n, a, b, 0.0) < q)


def test_batched_quantiles_equal_one_by_one():
    rng = np.random.default_rng(2)
    n, mu, kappa, pi = rng.integers(0, 60, 300), rng.random(300), rng.choice([3.0, 40.0], 300), rng.choice([0.0, 0.2], 300)
    n[:50], mu[:50], kappa[:50], pi[:50] = 7, 0.3, 3.0, 0.2
    m = plain.Mixture()
    want = [[m.ppf(q, int(k), x * c, (1 - x) * c, z) for q in (0.05, 0.5, 0.95)] for k, x, c, z in zip(n, mu, kappa, pi, strict=True)]
    assert np.array_equal(zibb.quantiles(n, mu, kappa, pi, (0.05, 0.5, 0.95)), want)
    some = np.arange(300) % (n + 1)
    upto, below = zibb.distribution(some, n, mu, kappa, pi)
    ends = [(m.cdf(int(v), int(k), x * c, (1 - x) * c, z), m.cdf(int(v) - 1, int(k), x * c, (1 - x) * c, z)) for v, k, x, c, z in zip(some, n, mu, kappa, pi, strict=True)]
    assert np.allclose(np.stack([upto, below], axis=1), ends, atol=1e-9)
    y = np.arange(31)
    assert np.exp(special.zibb_logpmf(y, 30, 2.0, 5.0, 0.3)).sum() == pytest.approx(1)
    assert np.exp(special.zibb_logpmf(0, 30, 2.0, 5.0, 0.3)) == pytest.approx(0.3 + 0.7 * np.exp(special.bb_logpmf(0, 30, 2.0, 5.0)))


def test_adaptive_edges_merge_until_bins_are_full():
    rng = np.random.default_rng(5)
    for least in (1, 5, 40, 1000):
        mu = np.round(rng.beta(0.4, 3, 400), 2)
        edges = plain.adaptive_edges(mu, 20, least)
        counts = np.bincount(plain.bin_of(mu, edges), minlength=len(edges) - 1)
        assert len(counts) == 2 or counts.min() >= least
        assert counts.sum() == 400 and np.all(np.diff(edges) > 0)
    assert list(plain.adaptive_edges(np.full(9, 0.2), 5, 1)) == [0.0, 1.0]


def test_newton_response_is_the_top_of_its_quadratic():
    rng = np.random.default_rng(6)
    y, n = rng.integers(0, 30, (4, 9)).astype(float), np.full((4, 9), 40.0)
    s = simplex.Settings(robust=0)
    p, h = rng.uniform(0.2, 0.8, (4, 9)), 1e-4
    loglik = lambda p: (y + 3.0 + s.jitter / 2) * np.log(p) + (n - y + 7.0 + s.jitter / 2) * np.log(1 - p)
    first, second = (loglik(p + h) - loglik(p - h)) / (2 * h), (loglik(p + h) - 2 * loglik(p) + loglik(p - h)) / h**2
    w, top = simplex.working_response(y, n, np.full(9, 0.3), np.full(9, 10.0), p, s)
    assert np.allclose(w, -second, rtol=1e-3) and np.allclose(top, np.clip(p - first / second, s.clip, 1 - s.clip), atol=1e-4)


def test_variances_given_the_sum():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    h, meat, theta = a.T @ a + np.eye(4), b.T @ b + np.eye(4), np.array([0.5, 0.3, 0.2, 0.0])
    cov = np.linalg.inv(h[:3, :3]) @ meat[:3, :3] @ np.linalg.inv(h[:3, :3])
    x = rng.multivariate_normal(np.zeros(3), cov, 200_000)
    total = x.sum(axis=1)
    residual = x - np.outer(total, x.T @ total / (total @ total))
    assert np.allclose(simplex._variance_given_sum(h, meat, theta, 1e-6)[:3], residual.var(axis=0), rtol=0.03) and simplex._variance_given_sum(h, meat, theta, 1e-6)[3] == 0


def test_bb_table_of_large_counts_does_not_underflow():
    t = special.bb_table(5000, 4e5, 2e5)
    assert t[-1] == 1 and 0.4 < t[3333] < 0.6


def test_smoother_is_stationary():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 40)
    y = rng.binomial(n, 0.1 + 0.3 * np.linspace(0, 1, 40))
    s = rw2.smooth(y, n)
    assert abs(np.sum(n * s.mu - y)) < 1e-3 and abs(np.sum(np.arange(40) * (n * s.mu - y))) < 1e-2 and np.all((s.lo <= s.mu) & (s.mu <= s.hi))
    assert rw2.smooth([3], [10]).mu[0] == pytest.approx(0.3, abs=1e-3)


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 10)), min_size=1, max_size=15))
def test_isotonic_is_monotone_and_keeps_the_mean(rows):
    y, w = (np.array(x) for x in zip(*rows, strict=True))
    f = plain.isotonic(y, w)
    assert np.all(np.diff(f) >= -1e-12) and (f @ w) == pytest.approx(y @ w)


def test_mixture_fit_recovers_rate_and_spread():
    rng = np.random.default_rng(8)
    day = np.repeat(np.arange(30), 40)
    n = rng.integers(50, 200, len(day))
    y = rng.binomial(n, rng.beta(0.2 * 30, 0.8 * 30, len(day))) * (rng.random(len(day)) > 0.1)
    f = plain.fit(day, 30, y, n, plain.Settings())
    assert abs(np.median(f.mu) - 0.2) < 0.03 and 10 < np.median(f.kappa) < 70 and 0.03 < np.median(f.pi) < 0.2
    lo, hi = zibb.intervals(n, f.mu, f.kappa / plain.widening(f, y, n, plain.Settings())[f.bins], f.pi, 0.9)
    assert np.mean((y >= lo) & (y <= hi)) > 0.86


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=8))
def test_projection(v):
    p = simplex.project(np.array(v))[0]
    assert p.sum() == pytest.approx(1) and np.all(p >= 0) and np.allclose(simplex.project(p)[0], p, atol=1e-9)
    order = np.argsort(v)
    assert np.all(np.diff(p[order]) >= -1e-12)


def test_quadratic_equals_enumeration_of_supports():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.normal(size=(6, 4))
        h, f = a.T @ a + 0.1 * np.eye(4), rng.normal(size=4)
        best = np.inf
        for r in range(1, 5):
            for free in map(list, itertools.combinations(range(4), r)):
                k = np.block([[h[np.ix_(free, free)], np.ones((r, 1))], [np.ones((1, r)), np.zeros((1, 1))]])
                x = np.zeros(4)
                x[free] = np.linalg.solve(k, np.r_[f[free], 1])[:r]
                if np.all(x >= -1e-12):
                    best = min(best, 0.5 * x @ h @ x - f @ x)
        z = simplex.quadratic_on_simplex(h[None], f[None], np.array([1.0]), 1e-9, 5000)[0]
        assert 0.5 * z @ h @ z - f @ z == pytest.approx(best, abs=1e-6)


def test_site_solver_recovers_shares():
    rng = np.random.default_rng(4)
    S = (rng.random((30, 3)) < 0.4).astype(float)
    S[np.arange(3), np.arange(3)] = 1
    truth = np.array([0.6, 0.3, 0.1])
    n = np.full((5, 30), 2000.0)
    y = rng.binomial(2000, np.clip(S @ truth, 0.001, 0.999), (5, 30)).astype(float)
    out = simplex.solve(S, y, n, np.full(30, 0.5), np.zeros(30), simplex.Settings())
    assert np.allclose(out.theta, truth, atol=0.05) and np.all(out.sd >= 0) and np.all((out.leverage >= 0) & (out.leverage <= 1))


def test_resampling_is_proportional():
    rng = np.random.default_rng(0)
    w = np.array([0.5, 0.25, 0.25])
    assert np.allclose(np.bincount(particles.systematic(np.repeat(w, 4) / 4, rng), minlength=12).reshape(3, 4).sum(axis=1) / 12, w, atol=0.1)


def test_filter_follows_shares_and_repeats():
    S = np.array([[1, 0], [0, 1], [1, 1.0], [0, 1]])
    truth = np.stack([np.linspace(0.8, 0.2, 12), np.linspace(0.2, 0.8, 12)], axis=1)
    n = np.full((12, 4), 300.0)
    y = np.round(n * np.clip(truth @ S.T, 0, 1))
    s = particles.Settings(particles=200)
    runs = [particles.run_filter(y, n, S, np.full(4, 200.0), np.full(2, 0.5), s, particles.generator(1, "site")) for _ in range(2)]
    means = np.array([np.exp(lw) @ p for p, lw in zip(runs[0].particles, runs[0].log_w, strict=True)])
    assert np.abs(means - truth)[2:].max() < 0.12 and np.array_equal(runs[0].evidence, runs[1].evidence)
    assert particles.backward_path(runs[0], s, particles.generator(1, "b")).sum(axis=1) == pytest.approx(np.ones(12))
    path, trace = particles.most_probable_path(means, y, n, S, np.full(4, 200.0), s)
    assert np.all(np.diff(trace) <= 1e-9) and np.allclose(path.sum(axis=1), 1, atol=1e-6)
    shares, counts = particles.next_day(runs[0], n, S, np.full(4, 200.0), s, particles.generator(1, "c"))
    assert shares.shape == (200, 2) and counts.shape == (s.draws, 4) and counts.max() <= 300
    u = particles.pits(np.exp(runs[0].log_w[3]), runs[0].particles[3], y[3], n[3], S, np.full(4, 200.0), s, particles.generator(1, "d"))
    assert len(u) == 4 and np.all((0 <= u) & (u <= 1))


def test_quantiles_of_large_counts_equal_the_table(monkeypatch):
    rng = np.random.default_rng(12)
    n = rng.choice([50, 900, 3000], 60)
    mu, kappa, pi = rng.uniform(0.001, 0.999, 60), rng.choice([2.0, 40.0, 3000.0], 60), rng.choice([0.0, 0.3], 60)
    levels = (0.0, 0.05, 0.25, 0.5, 0.95, 0.999)
    want = zibb.quantiles(n, mu, kappa, pi, levels)
    monkeypatch.setattr(zibb, "TABLE", 10)
    monkeypatch.setattr(zibb, "PIECE", 97)
    assert np.array_equal(zibb.quantiles(n, mu, kappa, pi, levels), want)


def test_quantiles_of_a_million_need_little_memory():
    import tracemalloc

    tracemalloc.start()
    lo, mid, hi = zibb.quantiles(np.array([1_000_000]), np.array([0.3]), np.array([500.0]), np.array([0.0]), (0.05, 0.5, 0.95))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sd = (1e6 * 0.3 * 0.7 * (1e6 + 500) / 501) ** 0.5
    assert peak < 20e6 and abs(mid - 300_000) < 0.1 * sd and abs(hi - mid - 1.645 * sd) < 0.1 * sd and abs(mid - lo - 1.645 * sd) < 0.1 * sd


def test_distribution_at_one_count_equals_the_table():
    rng = np.random.default_rng(21)
    for n in (0, 1, 7, 40, 1000, 60_000):
        mu, phi = rng.uniform(0.0005, 0.9995, 40), rng.choice([1.0, 8.0, 200.0, 30_000.0], 40)
        mu[:2] = 1e-12, 1 - 1e-12
        a, b = mu * phi, (1 - mu) * phi
        table = special.bb_tables(n, a, b)
        for k in {0, n, n // 2, n // 3, n // 50, n - n // 7, n - n // 100}:
            upto, mass = special.bb_upto(k, n, a, b)
            assert np.allclose(upto, table[:, k], rtol=0, atol=1e-9) and np.allclose(mass, table[:, k] - (table[:, k - 1] if k else 0), rtol=0, atol=1e-9)


def test_transforms_of_large_counts_take_no_longer():
    import time

    theta, S, phi = np.full((128, 2), 0.5), np.array([[1.0, 0.0], [0.4, 0.0]]), np.full(2, 200.0)
    began = time.perf_counter()
    for n in (1e8, 2e9):
        u = particles.pits(np.full(128, 1 / 128), theta, np.array([0.5, 0.2]) * n, np.full(2, n), S, phi, particles.Settings(), particles.generator(1, "x"))
        assert np.all(np.abs(u - 0.5) < 0.05)
    assert time.perf_counter() - began < 10
