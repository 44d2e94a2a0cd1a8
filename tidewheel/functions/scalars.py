"""Scalar column expressions. None of them emits NaN or an infinity."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the normal distribution's approximation (error below 7.5e-8).
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_T = 0.2316419
#: Intercept and slope of the recession probit on the term spread.
PROBIT = (-0.5333, -0.6629)


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_cdf(x: Column | str) -> Column:
    x = c(x)
    t = 1 / (1 + NORMAL_T * F.abs(x))
    poly = F.lit(0.0)
    for k in reversed(NORMAL):
        poly = t * (F.lit(k) + poly)
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def recession_probability(spread: Column | str) -> Column:
    return normal_cdf(F.lit(PROBIT[0]) + F.lit(PROBIT[1]) * c(spread))


def garman_klass(o: str, h: str, l: str, cl: str) -> Column:  # noqa: E741
    """Volatility of one bar; null if a price is missing or not positive."""
    ok = (c(o) > 0) & (c(h) > 0) & (c(l) > 0) & (c(cl) > 0)
    hl, co = F.ln(c(h) / c(l)), F.ln(c(cl) / c(o))
    return F.when(ok, F.sqrt(F.greatest(F.lit(0.0), 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)))


def clip_return(x: Column | str) -> Column:
    return F.greatest(c(x), F.lit(-1.0))


def classify(x: Column | str, level: float, tolerance: float = 0.0) -> Column:
    """above, below or at a level; null stays null."""
    x = c(x)
    return F.when(x > level + tolerance, "above").when(x < level - tolerance, "below").when(x.isNotNull(), "at")


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(c(a), c(b))


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series eight above, less the factors between."""
    s = z + 8
    series = (s - 0.5) * F.ln(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * F.pow(s, F.lit(3.0))) + 1 / (1260 * F.pow(s, F.lit(5.0))) - 1 / (1680 * F.pow(s, F.lit(7.0))) + 1 / (1188 * F.pow(s, F.lit(9.0)))
    for k in range(8):
        series = series - F.ln(z + k)
    return series


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, front to back, with two factors for each step; it settles
    after a number of steps that grows with the root of the larger parameter."""

    def factors(k: Column) -> Column:
        even = k * (b - k) * x / ((a - 1 + 2 * k) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 1 + 2 * k))
        return F.array(even, odd)

    def turn(s: Column, factor: Column) -> Column:
        # the product lags by one turn, so that no part is made twice
        return F.struct(F.try_divide(F.lit(1.0), 1 + factor * s["low"]).alias("low"), (1 + F.try_divide(factor, s["high"])).alias("high"), (s["value"] * s["low"] * s["high"]).alias("value"))

    start = F.struct(F.try_divide(F.lit(1.0), 1 - (a + b) * x / (a + 1)).alias("low"), F.lit(1.0).alias("high"), F.lit(1.0).alias("value"))
    steps = F.sequence(F.lit(1), F.ceil(30 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    every = F.flatten(F.transform(steps, lambda k: bound(k.cast("double"), factors)))
    return F.aggregate(every, start, turn, lambda s: s["value"] * s["low"] * s["high"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and x from 0 to 1."""

    def value(q: Column) -> Column:
        a, b, x = q["a"], q["b"], q["x"]
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        part = front * _beta_fraction(a, b, x) / a
        return F.when(q["turned"], 1 - part).otherwise(part)

    def sided(q: Column) -> Column:
        # the side on which the fraction settles fast
        low = q["x"] < (q["a"] + 1) / (q["a"] + q["b"] + 2)
        one = F.struct(q["a"].alias("a"), q["b"].alias("b"), q["x"].alias("x"), F.lit(False).alias("turned"))
        other = F.struct(q["b"].alias("a"), q["a"].alias("b"), (1 - q["x"]).alias("x"), F.lit(True).alias("turned"))
        return F.when(q["x"] <= 0, 0.0).when(q["x"] >= 1, 1.0).otherwise(bound(F.when(low, one).otherwise(other), value))

    return bound(F.struct(a.alias("a"), b.alias("b"), x.alias("x")), sided)


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a Pearson correlation of n pairs; 1 where there is no correlation or fewer than three pairs."""
    r, n = c(r), c(n)
    p = incomplete_beta((n.cast("double") - 2) / 2, F.lit(0.5), 1 - r * r)
    return F.when(r.isNull() | F.isnan(r) | (n < 3), 1.0).when(F.abs(r) >= 1, 0.0).otherwise(p)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where one side doesn't vary."""
    both = c(x).isNotNull() & c(y).isNotNull()
    return F.try_divide(F.covar_pop(c(x), c(y)), F.stddev_pop(F.when(both, c(x))) * F.stddev_pop(F.when(both, c(y))))
