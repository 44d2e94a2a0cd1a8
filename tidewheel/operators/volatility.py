"""Volatility forecasts: log-space regressions on the means of one-bar volatility, walk-forward over all symbols at once.

Expanding folds are sums of parts: every row enters the Gram sums of its part once, and a fold's sums are the
running sum over the parts before it. Only the small systems are solved in numpy, grouped by symbol and fold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from .evaluation import soft_descent
from .series import ewma

#: The least volatility that logs and losses see, and the horizon in rows.
FLOOR, HORIZON = 0.002, 5
HAR = ("har_vol_1d", "har_vol_5d", "har_vol_22d")


def target(keys: list[str], horizon: int = HORIZON) -> Column:
    """Mean volatility of the next rows, only where all of them are there."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(1, horizon)
    return F.when(F.count("gk_vol").over(w) == horizon, F.avg("gk_vol").over(w))


def sliced(rows: DataFrame, most: int = 252, share: float = 0.2, least: int = 60, horizon: int = HORIZON) -> DataFrame:
    """Rows with all inputs: slice (dev or holdout, the last ones), y (the target, made inside its slice)."""
    own = rows.dropna("any", subset=["gk_vol", *HAR])
    w = W.partitionBy("symbol")
    i, n = F.row_number().over(w.orderBy("date")) - 1, F.count(F.lit(1)).over(w)
    size = F.least(F.lit(most), F.floor(share * n))
    own = own.withColumns({"__i": i, "__n": n}).withColumn("__size", F.when(n - size >= least, size).otherwise(0))
    own = own.withColumn("slice", F.when(F.col("__i") >= F.col("__n") - F.col("__size"), "holdout").otherwise("dev")).drop("__i", "__n", "__size")
    return own.withColumn("y", target(["symbol", "slice"], horizon))


def parted(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Trainable rows with their part: 0 is trained on only, 1 to ``folds`` are tested, then the holdout."""
    own = rows.where("y is not null")
    w = W.partitionBy("symbol", "slice")
    j, n = F.row_number().over(w.orderBy("date")) - 1, F.count(F.lit(1)).over(w)
    t = F.floor(n / (folds + 1))
    part = F.when(F.col("slice") == "holdout", folds + 1).when(j < n - folds * t, 0).otherwise(F.floor((j - (n - folds * t)) / t) + 1)
    return own.withColumns({"part": part.cast("int"), "n_dev": F.when(F.col("slice") == "dev", n)})


def logs(names: tuple[str, ...] = HAR) -> list[Column]:
    return [F.ln(F.greatest(F.col(n), F.lit(FLOOR))) for n in names]


def fitted(rows: DataFrame, by: list[str], ridge: float = 0.0, lasso: float = 0.0, models: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(by, part, n, coefficients) from all rows of the group whose part is smaller. With ``models`` (name -> ridge, lasso) there is a row for
    each of them, with its name in ``model``: the sums are made once."""
    many = models or {"": (ridge, lasso)}
    cols = [F.lit(1.0), *logs(), F.ln(F.greatest("y", F.lit(FLOOR)))]
    m = len(cols)
    names = [f"g{k}" for k in range(m * (m + 1) // 2)]
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    own = rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(cols[a] * cols[b]).alias(k) for k, (a, b) in zip(names, pairs, strict=True)))
    before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = own.select(*by, "part", F.sum("n").over(before).alias("n"), F.array(*(F.sum(k).over(before) for k in names)).alias("g")).where("n is not null")

    def solve(batches):
        for b in batches:
            for name, (l2, l1) in many.items():
                out = []
                for g in b["g"]:
                    full = np.zeros((m, m))
                    full[np.triu_indices(m)] = g
                    full += np.triu(full, 1).T
                    a = full[:-1, :-1] + l2 * np.diag([0.0] + [1.0] * (m - 2))
                    beta = np.linalg.lstsq(a, full[:-1, -1], rcond=None)[0]
                    out.append(soft_descent(a, full[:-1, -1], l1 * full[0, 0], beta) if l1 else beta)
                yield b.drop(columns="g").assign(coefficients=out, model=name)

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*by, "part"])
    got = sums.mapInPandas(solve, f"{schema}, n long, coefficients array<double>, model string")
    return got if models else got.drop("model")


def log_forecast(c: str = "coefficients") -> Column:
    out = F.col(c)[0]
    for k, x in enumerate(logs()):
        out = out + F.col(c)[k + 1] * x
    return out


def smeared(rows: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """``models`` with smear: the mean of exp(residual) over the rows that each was fitted on."""
    also = ["model"] if "model" in models.columns else []
    use = models.select(*by, F.col("part").alias("__part"), "coefficients", *also)
    res = rows.join(use, by).where("part < __part").withColumn("e", F.exp(F.ln(F.greatest("y", F.lit(FLOOR))) - log_forecast()))
    return models.join(res.groupBy(*by, F.col("__part").alias("part"), *also).agg(F.avg("e").alias("smear")), [*by, "part", *also])


def qlike(actual: str, pred: str) -> Column:
    ratio = F.pow(F.greatest(pred, F.lit(FLOOR)) / F.greatest(actual, F.lit(FLOOR)), F.lit(2.0))
    return ratio - F.ln(ratio) - 1


def forecasts(rows: DataFrame, ridge: float = 0.0, lasso: float = 0.0, regime: str | None = None, least: int = 30, folds: int = 5) -> DataFrame:
    """Out-of-sample rows of the folds and the holdout: symbol, date, slice, part, y, pred, base.

    ``base``: the EWMA of volatility up to the row, over the trainable rows before it. With a ``regime`` column, a row
    takes the model of its own regime where that has ``least`` rows, else the model of all.
    """
    return parted_forecasts(with_base(parted(rows, folds)), ridge, lasso, regime, least)


def with_base(rows: DataFrame) -> DataFrame:
    return ewma(rows, "symbol", "gk_vol").withColumnRenamed("ewma", "base")


def parted_forecasts(own: DataFrame, ridge: float = 0.0, lasso: float = 0.0, regime: str | None = None, least: int = 30) -> DataFrame:
    """``forecasts`` of rows that have their part and base."""
    models = smeared(own, fitted(own, ["symbol"], ridge, lasso), ["symbol"])
    out = own.where("part > 0").join(models.select("symbol", "part", "coefficients", "smear"), ["symbol", "part"])
    pred = F.exp(log_forecast()) * F.col("smear")
    if regime:
        parts = fitted(own, ["symbol", regime], ridge, lasso).where(F.col("n") >= least)
        parts = smeared(own, parts, ["symbol", regime]).select("symbol", regime, "part", F.col("coefficients").alias("c_own"), F.col("smear").alias("s_own"))
        out = out.join(parts, ["symbol", regime, "part"], "left")
        pred = F.coalesce(F.exp(log_forecast("c_own")) * F.col("s_own"), pred)
    return out.withColumn("pred", pred).select("symbol", "date", "slice", "part", "n_dev", "y", "pred", "base")


def swept(rows: DataFrame, horizons: tuple[int, ...], folds: tuple[int, ...], models: dict[str, tuple[float, float]], regime: str | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Rows and out-of-sample forecasts of a whole grid: each horizon and number of folds is a key of its own (symbol|horizon|folds), so one pass makes
    all their sums, and every model (and the one by ``regime``) is solved from the same sums. The forecasts' key ends with the model's name.
    ``keep`` may write the rows, which are read several times."""
    own = None
    for h in horizons:
        cut = sliced(rows, horizon=h)
        for k in folds:
            one = parted(cut, k).withColumn("symbol", F.concat_ws("|", "symbol", F.lit(str(h)), F.lit(str(k))))
            own = one if own is None else own.unionByName(one)
    own = keep(with_base(own))
    fit = smeared(own, fitted(own, ["symbol"], models=models), ["symbol"])
    out = own.where("part > 0").join(fit.select("symbol", "part", "model", "coefficients", "smear"), ["symbol", "part"])
    columns = ["date", "slice", "part", "n_dev", "y", "pred", "base"]
    out = out.withColumn("pred", F.exp(log_forecast()) * F.col("smear")).select(F.concat_ws("|", "symbol", "model").alias("symbol"), *columns)
    if regime:
        by = parted_forecasts(own, regime=regime)
        out = out.unionByName(by.select(F.concat_ws("|", "symbol", F.lit("rv_har_regime")).alias("symbol"), *columns))
    return own, out


def scores(out: DataFrame, folds: int = 5) -> DataFrame:
    """The metrics of each symbol: n_obs, oos_r2, qlike, baseline_qlike, qlike_skill_ratio, n_folds, folds_passed, and the same
    of the holdout."""
    rows = out.withColumns({"q": qlike("y", "pred"), "b": qlike("y", "base"), "sq": F.pow(F.col("y") - F.col("pred"), F.lit(2.0))})

    def of(test: Column, prefix: str) -> list[Column]:
        own = lambda x: F.when(test, x)
        r2 = 1 - F.try_divide(F.sum(own(F.col("sq"))), F.var_pop(own(F.col("y"))) * F.count(own(F.col("y"))))
        q, b = F.avg(own(F.col("q"))), F.avg(own(F.col("b")))
        return [F.coalesce(r2, F.lit(0.0)).alias(f"{prefix}oos_r2"), q.alias(f"{prefix}qlike"), b.alias(f"{prefix}baseline_qlike"), F.try_divide(q, b).alias(f"{prefix}qlike_skill_ratio")]

    dev, held = F.col("slice") == "dev", F.col("slice") == "holdout"
    whole = rows.groupBy("symbol").agg(F.max("n_dev").alias("n_obs"), *of(dev, ""), *of(held, "holdout_"), F.count(F.when(held, 1)).alias("holdout_n_obs"))
    passed = rows.where(dev).groupBy("symbol", "part").agg((F.avg("q") < F.avg("b")).cast("int").alias("ok"))
    passed = passed.groupBy("symbol").agg(F.lit(folds).alias("n_folds"), F.sum("ok").alias("folds_passed"))
    return whole.join(passed, "symbol")


def next_forecast(rows: DataFrame, ridge: float = 0.0, lasso: float = 0.0, horizon: int = HORIZON) -> DataFrame:
    """(symbol, date, forecast, annualised): the forecast after each symbol's last row, from all rows whose target is known."""
    own = rows.dropna("any", subset=["gk_vol", *HAR]).withColumn("y", target(["symbol"], horizon))
    last = own.groupBy("symbol").agg(F.max("date").alias("date"))
    known = own.where("y is not null").withColumn("part", F.lit(0))
    at = own.join(last, ["symbol", "date"]).withColumn("part", F.lit(1))
    # the last row is a part of its own after all others; its target is unknown and counts for nothing
    models = fitted(known.unionByName(at.withColumn("y", F.lit(FLOOR))), ["symbol"], ridge, lasso)
    models = smeared(known, models, ["symbol"])
    got = at.join(models.select("symbol", "coefficients", "smear"), "symbol").withColumn("forecast", F.exp(log_forecast()) * F.col("smear"))
    return got.select("symbol", "date", "forecast", (F.col("forecast") * F.sqrt(F.lit(252.0))).alias("annualised"))
