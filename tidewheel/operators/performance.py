"""Performance statistics as aggregate expressions over returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as X
from ..functions.scalars import c

YEAR = 252.0


def annual_return(x: Column | str) -> Column:
    """Growth a year; nothing earned over no rows, and -1 once all is lost."""
    total, n = F.product(1 + c(x)), F.count(c(x))
    return F.when(n == 0, 0.0).when(total <= 0, -1.0).otherwise(F.pow(total, F.lit(YEAR) / n) - 1)


def annual_vol(x: Column | str) -> Column:
    return F.when(F.count(c(x)) > 1, F.stddev_samp(c(x)) * F.sqrt(F.lit(YEAR))).otherwise(0.0)


def sharpe(x: Column | str, risk_free: float = 0.0) -> Column:
    """Of excess returns with the sample deviation; 0 without variance or with fewer than two rows."""
    sd = F.stddev_samp(c(x))
    return F.when((F.count(c(x)) < 2) | (sd == 0), 0.0).otherwise((F.avg(c(x)) - risk_free / YEAR) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(YEAR)))


def drawdowns(df: DataFrame, keys: list[str], value: str = "daily_return", time: str = "date") -> DataFrame:
    """wealth, cumulative_return and drawdown; the peak starts at the first wealth, not at 1."""
    w = X.by(keys, time)
    out = df.withColumn("wealth", X.wealth(value, w))
    return out.withColumns({"cumulative_return": F.col("wealth") - 1, "drawdown": F.col("wealth") / F.max("wealth").over(X.upto(w)) - 1})


def regime_performance(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    """Days, share, return, volatility and Sharpe of each window, strategy and regime."""
    rows = returns.join(regimes, "date")
    got = rows.groupBy("window_id", "strategy", "regime").agg(
        F.count(F.lit(1)).alias("n_days"), (F.avg("daily_return") * YEAR).alias("ann_return"), (F.stddev_samp("daily_return") * F.sqrt(F.lit(YEAR))).alias("ann_vol")
    )
    total = F.sum("n_days").over(X.W.partitionBy("window_id", "strategy"))
    return got.withColumns({"share": F.col("n_days").cast("double") / total, "sharpe": F.col("ann_return") / F.nullif("ann_vol", F.lit(0.0))})
