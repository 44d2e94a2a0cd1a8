"""Data contracts: each returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c


def unique_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def column_checks(df: DataFrame, not_null: list[str] = (), accepted: dict[str, list] | None = None, unique: list[str] = ()) -> DataFrame:
    """(contract, violations), in one pass; of values that repeat every row beyond the first breaks ``unique``."""
    checks = {f"{x} not null": c(x).isNull() for x in not_null}
    checks |= {f"{x} accepted": c(x).isNotNull() & ~c(x).isin(values) for x, values in (accepted or {}).items()}
    sums = {k: F.coalesce(F.sum(v.cast("long")), F.lit(0)) for k, v in checks.items()}
    checks = sums | {f"{x} unique": F.count(c(x)) - F.countDistinct(c(x)) for x in unique}
    one = df.agg(*(v.alias(k) for k, v in checks.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("contract"), F.col(f"`{k}`").alias("violations")) for k in checks))))


def bounds(df: DataFrame, value: str, limit: float) -> DataFrame:
    return df.where(F.abs(value) > limit)


def interval_ordered(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """A missing end breaks the contract, too."""
    return df.where(~F.coalesce(c(lo) <= c(hi), F.lit(False)))


def pair_consistent(df: DataFrame, a: str, b: str, diff: str, lo: str, hi: str, flag: str, tolerance: float = 1e-9) -> DataFrame:
    """diff is a - b, and the flag says whether the interval leaves out zero."""
    ok = (F.abs(c(a) - c(b) - c(diff)) <= tolerance) & (c(flag) == ((c(lo) > 0) | (c(hi) < 0)))
    return df.where(~F.coalesce(ok, F.lit(False)))


def reconciles(df: DataFrame, keys: list[str], part: str, total: str, tolerance: float = 1e-6) -> DataFrame:
    got = df.groupBy(*keys).agg(F.sum(part).alias("parts"), F.max(total).alias("total"))
    return got.where(~F.coalesce(F.abs(c("parts") - c("total")) <= tolerance, F.lit(False)))


def allowlist(df: DataFrame, col: str, allowed: DataFrame) -> DataFrame:
    return df.select(col).distinct().join(allowed, col, "left_anti")


def fresh(df: DataFrame, key: str, time: str, as_of: str, days: int) -> DataFrame:
    got = df.groupBy(key).agg(F.max(time).alias("latest"))
    return got.where(F.date_diff(F.lit(as_of).cast("date"), "latest") > days)


def before_start(df: DataFrame, keys: list[str], value: str, time: str = "date") -> DataFrame:
    """Rows of a key before its first value other than 0."""
    start = df.where(c(value) != 0).groupBy(*keys).agg(F.min(time).alias("__start"))
    return df.join(start, keys, "left").where(F.col("__start").isNull() | (c(time) < F.col("__start"))).drop("__start")
