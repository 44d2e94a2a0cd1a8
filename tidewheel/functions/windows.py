"""Window expressions over keyed series. A result is null unless its frame holds ``least`` values."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import c


def by(keys: str | list[str], time: str = "date") -> WindowSpec:
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(time)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def before_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def enough(value: Column, x: Column | str, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(c(x)).over(frame) >= least, value)


def rolling(fn, x: Column | str, frame: WindowSpec, least: int) -> Column:
    return enough(fn(c(x)).over(frame), x, frame, least)


def change(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return c(x) - F.lag(c(x), n).over(w)


def pct_change(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(c(x), F.lag(c(x), n).over(w)) - 1


def ffill(x: Column | str, w: WindowSpec) -> Column:
    return F.last(c(x), ignorenulls=True).over(upto(w))


def wealth(r: Column | str, w: WindowSpec) -> Column:
    """Running product of 1 + r; exact where a return is -1."""
    return F.product(1 + c(r)).over(upto(w))


def zscore(x: Column | str, frame: WindowSpec, least: int) -> Column:
    sd = F.stddev_samp(c(x)).over(frame)
    return enough((c(x) - F.avg(c(x)).over(frame)) / F.nullif(sd, F.lit(0.0)), x, frame, least)


def skew(x: Column | str, frame: WindowSpec, least: int) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(c(x)).over(frame).cast("double")
    return F.when(n >= max(3, least), F.skewness(c(x)).over(frame) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column | str, frame: WindowSpec, least: int) -> Column:
    """Bias-corrected sample excess kurtosis."""
    n = F.count(c(x)).over(frame).cast("double")
    g = F.kurtosis(c(x)).over(frame)
    return F.when(n >= max(4, least), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))
