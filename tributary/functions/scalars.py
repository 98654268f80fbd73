"""Scalar functions as columns: names, fractions, logits and the log-gamma family."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonicalize_strict(c: Column) -> Column:
    """Null is empty; trimmed, upper case, without blanks, `->` and all outside A-Z, 0-9, `:`, `_`, `-`."""
    plain = F.replace(F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("")), F.lit("->"), F.lit(""))
    return F.regexp_replace(plain, r"[^A-Z0-9:_\-]", "")


def stripped(c: Column) -> Column:
    """Without white space of any kind, tabs and line ends too, at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_mutation(c: Column) -> Column:
    """Stripped, upper case; unlike canonicalize_strict it keeps other signs, such as the `*` of a stop."""
    return F.upper(stripped(c))


def allele_fraction(count: Column, coverage: Column) -> Column:
    return F.when(coverage > 0, F.least(F.greatest(count / coverage, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def detection_limit(coverage: Column, least: float = 0.01, min_alt: int = 2) -> Column:
    return F.when(coverage > 0, F.greatest(F.lit(least), F.lit(float(min_alt)) / coverage)).otherwise(least)


def safe_key(c: Column) -> Column:
    r"""Runs of `\W` as `_`, lower case, without `_` at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\W+", "_")), "^_+|_+$", "")


def allowed_name(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9:_\-]*$")


def text_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.+]", "")


def clip01(c: Column, eps: float = 1e-12) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))


def logit(c: Column, eps: float = 1e-12) -> Column:
    p = clip01(c, eps)
    return F.log(p / (1 - p))


def expit(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softplus(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and named, so that formulas that use it often stay small trees."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stirling(y: Column) -> Column:
    """Logarithm of the gamma function for y >= 8."""
    tail = lambda z: 1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360)))))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + let(1 / (y * y), tail) / y


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: shifted by 8 below 8, then Stirling's series."""

    def of(v: Column) -> Column:
        low = v
        for k in range(1, 8):
            low = low * (v + k)
        return let(F.when(v < 8, v + 8).otherwise(v), _stirling) - F.when(v < 8, F.log(low)).otherwise(0.0)

    return let(x.cast("double"), of)


def betaln(a: Column, b: Column) -> Column:
    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), lambda v: lgamma(v["a"]) + lgamma(v["b"]) - lgamma(v["a"] + v["b"]))


def log_choose(n: Column, k: Column) -> Column:
    return let(F.struct(n.cast("double").alias("n"), k.cast("double").alias("k")), lambda v: lgamma(v["n"] + 1) - lgamma(v["k"] + 1) - lgamma(v["n"] - v["k"] + 1))


def betabinom_logpmf(y: Column, n: Column, a: Column, b: Column) -> Column:
    """Null where n is 0 or y lies outside 0 .. n."""
    value = log_choose(n, y) + betaln(y + a, n - y + b) - betaln(a, b)
    return F.when((n > 0) & (y >= 0) & (y <= n), value)


def normal_cdf(z: Column) -> Column:
    """Within 1e-14 or so: a series near 0, a continued fraction in the tails."""

    def upper(x: Column) -> Column:
        density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = lambda acc, k: F.struct((acc["term"] * x * x / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * x * x / (2 * k + 1)).alias("total"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(70)), F.struct(x.alias("term"), x.alias("total")), step)["total"]
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
        return F.when(x < 3.5, 0.5 - density * series).otherwise(density / fraction)

    return let(z.cast("double"), lambda v: let(let(F.abs(v), upper), lambda u: F.when(v > 0, 1 - u).otherwise(u)))


_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution by Acklam's rational approximation (relative error 1.2e-9); null outside (0, 1)."""

    def of(v: Column) -> Column:
        q = v - 0.5
        outer = let(F.sqrt(-2 * F.log(F.least(v, 1 - v))), lambda t: _poly(t, _C) / _poly(t, (*_D, 1.0)))
        inner = let(q * q, lambda r: _poly(r, _A) / _poly(r, (*_B, 1.0)))
        return F.when((v <= 0) | (v >= 1), F.lit(None).cast("double")).when(F.abs(q) <= 0.47575, q * inner).otherwise(F.when(q < 0, outer).otherwise(-outer))

    return let(p.cast("double"), of)
