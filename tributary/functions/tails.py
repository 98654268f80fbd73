"""Tail probabilities of test statistics as columns. Series and continued fractions are folds of fixed length."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, lgamma

TERMS = 200


def _sum(terms: int, term) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + term(k))


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function for a > 0: a series up to x = a + 1, a continued fraction (from its end) beyond."""

    def of(s: Column) -> Column:
        a, x = s["a"], s["x"]
        scale = F.exp(a * F.log(x) - x - lgamma(a))
        grow = lambda acc, k: let(acc["term"] * x / (a + k), lambda t: F.struct(t.alias("term"), (acc["total"] + t).alias("total")))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct((1 / a).alias("term"), (1 / a).alias("total")), grow)["total"]
        # x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...))
        fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x + 2 * TERMS + 1 - a, lambda acc, k: x + 2 * k - 1 - a - k * (k - a) / acc)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - scale * series).otherwise(scale / fraction)

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), of)


def chi_square_tail(x: Column, freedom: Column) -> Column:
    return gamma_upper(freedom / 2, x / 2)


def kolmogorov_tail(d: Column, n: Column) -> Column:
    """Limit distribution of the Kolmogorov distance of n values: the alternating series, or its theta transform for small distances."""

    def of(t: Column) -> Column:
        far = 2 * _sum(100, lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * t * t))
        near = 1 - math.sqrt(2 * math.pi) / t * _sum(20, lambda k: F.exp(-(2 * k - 1) * (2 * k - 1) * (math.pi**2 / 8) / (t * t)))
        return F.when(t <= 0.04, 1.0).when(t < 1.0, near).otherwise(F.least(F.greatest(far, F.lit(0.0)), F.lit(1.0)))

    return let(d * F.sqrt(n.cast("double")), of)


#: Steps of the integral of the Bessel function in cramer_von_mises_tail, and their width: up to t = 14, where y (1 + cosh t) is above 40 for statistics up to 900.
_NODES, _WIDTH = 280, 0.05


def cramer_von_mises_tail(w: Column) -> Column:
    """Limit distribution of the Cramer-von Mises statistic, by its series over Bessel functions of order 1/4.

    exp(-y) K(y) is the integral of exp(-y (1 + cosh t)) cosh(t / 4) over t > 0, by the trapezoidal rule.
    """

    def of(x: Column) -> Column:
        def term(k: int) -> Column:
            y = (4 * k + 1) ** 2 / (16 * x)
            nodes = F.aggregate(F.sequence(F.lit(1), F.lit(_NODES)), F.exp(-2 * y) / 2, lambda acc, j: acc + F.exp(-y * (1 + F.cosh(j * _WIDTH))) * F.cosh(j * (_WIDTH / 4)))
            return math.gamma(k + 0.5) / (math.gamma(0.5) * math.factorial(k)) * math.sqrt(4 * k + 1) * _WIDTH * nodes

        total = term(0)
        for k in range(1, 12):
            total = total + term(k)
        return F.when(x <= 0, 1.0).otherwise(F.least(F.greatest(1 - total / (math.pi * F.sqrt(x)), F.lit(0.0)), F.lit(1.0)))

    return let(w.cast("double"), of)


def skewness_score(skew: Column, n: Column) -> Column:
    """D'Agostino's normal score of a sample skewness (population form), for n of 8 or more."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    return let(F.struct(y.alias("y"), w2.alias("w2")), lambda s: F.asinh(s["y"] / F.sqrt(2 / (s["w2"] - 1))) / F.sqrt(F.log(s["w2"]) / 2))


def kurtosis_score(excess: Column, n: Column) -> Column:
    """Anscombe's and Glynn's normal score of a sample's excess kurtosis (population form), for n of 20 or more."""
    x = (excess + 3 - 3.0 * (n - 1) / (n + 1)) / F.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5)))
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))

    def of(s: Column) -> Column:
        a = s["a"]
        below = 1 + s["x"] * F.sqrt(2 / (a - 4))
        cube = F.signum(below) * F.pow((1 - 2 / a) / F.abs(below), F.lit(1 / 3))
        return (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))

    return let(F.struct(x.alias("x"), let(root, lambda r: 6 + 8 / r * (2 / r + F.sqrt(1 + 4 / (r * r)))).alias("a")), of)


def normality(skew: Column, excess: Column, n: Column) -> tuple[Column, Column]:
    """(K squared, p): both scores together, chi-square with two degrees of freedom; null for fewer than 20 values."""
    enough, n = n >= 20, n.cast("double")
    k2 = F.when(enough, skewness_score(skew, n) * skewness_score(skew, n) + kurtosis_score(excess, n) * kurtosis_score(excess, n))
    return k2, F.exp(-k2 / 2)
