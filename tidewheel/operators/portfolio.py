"""Portfolios: calendars, weights, a walk-forward backtest in closed form, bootstrap, attribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from .series import asof_multi

#: The modulus and multipliers of the counter-based mix.
P, A1, A2 = 2147483647, 48271, 69621


def calendar_align(assets: DataFrame, spine: DataFrame, value: str = "daily_return", key: str = "symbol") -> DataFrame:
    """Series on their own calendars -> returns on the spine's dates, for any number of keys in one pass: (key, date, value).

    Wealth is carried forward and returns compound over the dates between; a key's first date with wealth, and dates before it, have a null
    return. ``spine``: date. A row that repeats a key's date counts once. Work is dealt by key; the calendar goes to all keys as one row.
    """
    w = W.partitionBy(key).orderBy("date")
    once = assets.groupBy(key, "date").agg(F.first(value).alias(value))
    grown = once.select(key, "date", X.wealth(F.coalesce(value, F.lit(0.0)), w).alias("wealth"), F.lit(False).alias("on"))
    days = spine.distinct().agg(F.array_sort(F.collect_list("date")).alias("days"))  # a calendar: one row
    dense = once.select(key).distinct().crossJoin(F.broadcast(days)).select(key, F.explode("days").alias("date"), F.lit(None).cast("double").alias("wealth"), F.lit(True).alias("on"))
    filled = grown.unionByName(dense).withColumn("wealth", F.last("wealth", ignorenulls=True).over(X.upto(W.partitionBy(key).orderBy("date", "on"))))
    return filled.where("on").select(key, "date", X.pct_change("wealth", w).alias(value))


def common_start(panel: DataFrame, key: str = "symbol", value: str = "daily_return") -> DataFrame:
    """The rows from the date on by which every key has a value."""
    first = panel.where(F.col(value).isNotNull()).groupBy(key).agg(F.min("date").alias("f")).agg(F.max("f").alias("start"))
    return panel.crossJoin(F.broadcast(first)).where("date >= start").drop("start")  # one row


def window_panel(daily: DataFrame, rule: str, added: str, floor: Column | None = None, spine: DataFrame | None = None, key: str = "symbol", value: str = "daily_return") -> DataFrame:
    """(key, date, value) of a window. Rules: ``without``: all keys but ``added``, from the latest of their first dates on;
    ``floor``: the same keys from ``floor`` on; ``with``: these and ``added``, aligned to the spine, from ``floor`` on, without its
    leading dates. An unknown rule, or no floor where one is needed, gives all keys but ``added``, from the start.
    """
    rest = daily.where(F.col(key) != added).select(key, "date", value)
    if rule == "without":
        first = rest.groupBy(key).agg(F.min("date").alias("f")).agg(F.max("f").alias("start"))
        return rest.crossJoin(F.broadcast(first)).where("date >= start").drop("start")  # one row
    if floor is None or rule not in ("floor", "with"):
        return rest
    rest = rest.where(F.col("date") >= floor)
    if rule == "floor":
        return rest
    one = calendar_align(daily.where(F.col(key) == added), spine if spine is not None else rest.select("date"), value, key)
    return rest.unionByName(one.where(F.col(value).isNotNull() & (F.col("date") >= floor)))


def calendar_gaps(rows: DataFrame, spine: DataFrame, key: str = "symbol", value: str = "daily_return") -> DataFrame:
    """(key, leading, trailing, interior, n): dates of the spine without a value, by where they stand. The spine is
    joined to each key's first and last date with a value, not to all rows."""
    have = rows.where(F.col(value).isNotNull()).join(spine.distinct(), "date", "left_semi")
    ends = rows.select(key).distinct().join(have.groupBy(key).agg(F.min("date").alias("f"), F.max("date").alias("l"), F.countDistinct("date").alias("k")), key, "left")
    days = spine.distinct().agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("date")).alias("days"))  # a calendar: one row
    got = ends.crossJoin(F.broadcast(days))
    count = lambda test: F.size(F.filter("days", test)).cast("long")
    leading, trailing = F.coalesce(count(lambda x: x < F.col("f")), F.lit(0)), F.coalesce(count(lambda x: x > F.col("l")), F.lit(0))
    none = F.col("f").isNull()
    got = got.withColumns({"leading": F.when(none, 0).otherwise(leading).cast("long"), "trailing": F.when(none, 0).otherwise(trailing).cast("long")})
    return got.select(key, "leading", "trailing", F.when(none, 0).otherwise(F.col("n") - F.col("k") - F.col("leading") - F.col("trailing")).cast("long").alias("interior"), "n")


def complete_dates(returns: DataFrame) -> DataFrame:
    """Rows of the dates on which every symbol has a return."""
    have = returns.where("daily_return is not null")
    n = have.agg(F.countDistinct("symbol").alias("n_all"))
    full = have.groupBy("date").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where("n = n_all")  # one row
    return have.join(full.select("date"), "date", "left_semi")


def rebalance_dates(dates: DataFrame, warmup: int, every: str = "month") -> DataFrame:
    """The last date of each month or quarter after ``warmup`` rows."""
    after = dates.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date"))).where(F.col("i") > warmup)
    return after.groupBy(F.trunc("date", every).alias("period")).agg(F.max("date").alias("date"), F.max("i").alias("i")).select("date", "i")


def equal_weight(returns: DataFrame) -> DataFrame:
    return returns.groupBy("date").agg(F.avg("daily_return").alias("daily_return"), F.count("daily_return").alias("n"))


def trailing(returns: DataFrame, rebalances: DataFrame, lookback: int) -> DataFrame:
    """Each rebalance with the ``lookback`` rows strictly before it: rebalance, symbol, date, daily_return."""
    order = returns.select("date").distinct().withColumn("k", F.row_number().over(W.orderBy("date")))
    numbered = returns.join(order, "date")
    at = rebalances.join(order, "date").select(F.col("date").alias("rebalance"), F.explode(F.sequence(F.col("k") - lookback, F.col("k") - 1)).alias("k"))
    return at.join(numbered, "k").select("rebalance", "symbol", "date", "daily_return")


def covariances(window: DataFrame) -> DataFrame:
    """rebalance, a, b, cov: the sample covariance of each pair in each trailing window."""
    x = window.select("rebalance", "date", F.col("symbol").alias("a"), F.col("daily_return").alias("x"))
    y = window.select("rebalance", "date", F.col("symbol").alias("b"), F.col("daily_return").alias("y"))
    return x.join(y, ["rebalance", "date"]).where("a <= b").groupBy("rebalance", "a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def inverse_vol_weights(window: DataFrame, floor: float = 1e-12) -> DataFrame:
    inv = window.groupBy("rebalance", "symbol").agg((1 / F.sqrt(F.greatest(F.var_samp("daily_return"), F.lit(floor)))).alias("v"))
    return inv.select("rebalance", "symbol", (F.col("v") / F.sum("v").over(W.partitionBy("rebalance"))).alias("weight"))


def momentum_weights(window: DataFrame) -> DataFrame:
    """Equal weight over symbols whose trailing sum is positive; over all if there is none."""
    s = window.groupBy("rebalance", "symbol").agg(F.sum("daily_return").alias("s"))
    by = W.partitionBy("rebalance")
    n, k = F.count(F.lit(1)).over(by), F.sum((F.col("s") > 0).cast("int")).over(by)
    w = F.when(k == 0, 1.0 / n).when(F.col("s") > 0, 1.0 / k).otherwise(0.0)
    return s.select("rebalance", "symbol", w.alias("weight"))


def _matrix(part: pd.DataFrame) -> tuple[list[str], np.ndarray, pd.DataFrame]:
    wide = part.pivot(index="date", columns="symbol", values="daily_return").dropna()
    return list(wide.columns), np.atleast_2d(np.cov(wide.to_numpy().T)), wide


def shrunk(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk to a scaled identity by the closed-form intensity."""
    n, k = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / k
    d = ((s - mu * np.eye(k)) ** 2).sum() / k
    b = min(d, (((x**2).T @ (x**2)) / n - s**2).sum() / n / k)
    a = 0.0 if d == 0 else b / d
    return a * mu * np.eye(k) + (1 - a) * s


def shrunk_covariances(window: DataFrame) -> DataFrame:
    """rebalance, a, b, cov: each trailing window's covariance, shrunk."""

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, _, wide = _matrix(part)
        s = shrunk(wide.to_numpy())
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"rebalance": key[0], "a": [names[k] for k in i], "b": [names[k] for k in j], "cov": s[i, j]})

    return window.groupBy("rebalance").applyInPandas(solve, "rebalance date, a string, b string, cov double")


def _risk_parity(s: np.ndarray) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent."""
    k = len(s)
    w = 1 / np.sqrt(np.maximum(np.diag(s), 1e-12))
    for _ in range(200):
        before = w.copy()
        for i in range(k):
            c = s[i] @ w - s[i, i] * w[i]
            w[i] = (-c + np.sqrt(c * c + 4 * s[i, i] / k)) / (2 * max(s[i, i], 1e-12))
        if np.abs(w - before).max() < 1e-12 * w.max():
            break
    return w / w.sum()


def capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights that sum to 1 and lie between 0 and ``cap``."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    w = np.clip(v - hi, 0, cap)
    return w / w.sum()


def _max_sharpe(s: np.ndarray, mu: np.ndarray) -> np.ndarray:
    k = len(s)
    cap = max(0.4, 1 / k)
    w, step = np.full(k, 1 / k), 0.5
    best, score = w, -np.inf
    for _ in range(200):
        sd = np.sqrt(max(w @ s @ w, 1e-18))
        now = w @ mu / sd
        if now > score + 1e-14:
            best, score = w, now
        else:
            step *= 0.7
        g = mu / sd - (w @ mu) * (s @ w) / sd**3
        w = capped_simplex(best + step * g / (np.abs(g).max() + 1e-18), cap)
    return best


def fixed_weights(window: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same given weights at every rebalance; they must be finite, sum to 1 and name symbols of the window."""
    if not weights or not all(math.isfinite(w) for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must be finite and sum to 1")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    held = window.select("rebalance", "symbol").distinct()
    return held.withColumn("weight", F.coalesce(F.element_at(table, F.col("symbol")), F.lit(0.0)))


def known_at(rebalances: DataFrame, panel: DataFrame, value: str = "mu", key: str = "symbol") -> DataFrame:
    """(rebalance, key, value): for every rebalance and key the last value of the panel on that date or before. A forecast is dated
    by the last row that it has seen and a rebalance takes effect on the next date, so nothing later enters."""
    at = rebalances.select(F.col("rebalance").alias("date")).distinct()
    days = at.agg(F.array_sort(F.collect_list("date")).alias("days"))  # the rebalance dates: one row
    left = panel.select(key).distinct().crossJoin(F.broadcast(days)).select(key, F.explode("days").alias("date"))
    found = asof_multi(left, panel, {value: F.col(value)}, keys=[key])
    return found.where(F.col(value).isNotNull()).select(F.col("date").alias("rebalance"), key, value)


def blended(window: DataFrame, mu: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(rebalance, symbol, mu): the forecast where the rebalance has one, else the window's mean; with ``weight`` (rebalance, forecast_weight)
    the forecast's share of a blend of both. A rebalance on which a symbol lacks a forecast takes the means of all."""
    prior = window.groupBy("rebalance", "symbol").agg(F.avg("daily_return").alias("prior"))
    got = prior.join(mu, ["rebalance", "symbol"], "left").withColumn("whole", F.count("mu").over(W.partitionBy("rebalance")) == F.count(F.lit(1)).over(W.partitionBy("rebalance")))
    share = F.lit(1.0)
    if weight is not None:
        got, share = got.join(weight.select("rebalance", "forecast_weight"), "rebalance", "left"), F.coalesce("forecast_weight", F.lit(0.0))
    return got.select("rebalance", "symbol", F.when(F.col("whole"), share * F.col("mu") + (1 - share) * F.col("prior")).otherwise(F.col("prior")).alias("mu"))


def gate_weights(forecasts: DataFrame, rebalances: DataFrame, horizon: int, least: int = 20) -> DataFrame:
    """(rebalance, n, forecast_skill, forecast_weight): how much better than the mean of what they were trained on the forecasts were whose targets are known at the
    rebalance: 1 less the ratio of squared errors, from 0 to 1; the weight is the skill, 0 with fewer than ``least`` forecasts.

    ``forecasts``: symbol, date, y, pred, train_mean. A target is known ``horizon`` rows of the symbol later.
    """
    known = F.lead("date", horizon).over(X.by("symbol"))
    sq = lambda c: F.pow(F.col("y") - F.col(c), F.lit(2.0))
    days = forecasts.withColumn("known", known).where("known is not null and y is not null").groupBy(F.col("known").alias("date")).agg(F.sum(sq("pred")).alias("e"), F.sum(sq("train_mean")).alias("b"), F.count(F.lit(1)).alias("k"))
    # running sums over one row for each date, met by the rebalances as of their own
    w = X.upto(W.orderBy("date"))
    sums = days.select("date", *(F.sum(c).over(w).alias(c) for c in ("e", "b", "k")))
    at = rebalances.select("rebalance").distinct().withColumnRenamed("rebalance", "date")
    got = asof_multi(at, sums, {c: F.col(c) for c in ("e", "b", "k")})
    skill = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide("e", "b"))), F.lit(0.0))
    return got.select(F.col("date").alias("rebalance"), F.coalesce("k", F.lit(0)).alias("n"), skill.alias("forecast_skill")).withColumn("forecast_weight", F.when(F.col("n") >= least, F.col("forecast_skill")).otherwise(0.0))


def solved_weights(window: DataFrame, kind: str, mu: DataFrame | None = None) -> DataFrame:
    """risk_parity or max_sharpe weights: one small problem for each rebalance, all in parallel. ``mu`` (rebalance, symbol, mu)
    gives the expected returns of max_sharpe, else they are the window's means."""
    given = mu is not None
    if given:
        window = window.join(mu.select("rebalance", "symbol", "mu"), ["rebalance", "symbol"])

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, s, wide = _matrix(part)
        x = wide.to_numpy()
        if len(x) < 2:
            w = np.full(len(names), 1 / len(names))
        elif kind == "risk_parity":
            w = _risk_parity(s)
        else:
            expected = part.groupby("symbol").mu.first()[names].to_numpy() if given else x.mean(axis=0)
            w = _max_sharpe(shrunk(x), expected)
        return pd.DataFrame({"rebalance": key[0], "symbol": names, "weight": w})

    return window.groupBy("rebalance").applyInPandas(solve, "rebalance date, symbol string, weight double")


def backtest(returns: DataFrame, weights: DataFrame, cost: float = 0.0005) -> DataFrame:
    """date, symbol, weight (at the open), contribution, cost share, net of the whole date as net_return.

    Between rebalances weights drift in closed form: target times the growth since the rebalance,
    normalised. A rebalance takes effect on the first date after it and costs half its turnover
    times ``cost``; before the first one everything is cash.
    """
    marks = weights.select("rebalance").distinct()
    dates = returns.select("date").distinct()
    # each date's segment: the last rebalance strictly before it
    rows = dates.select("date", F.lit(1).alias("k")).unionByName(marks.select(F.col("rebalance").alias("date"), F.lit(2).alias("k")))
    seg = rows.withColumn("rebalance", F.last(F.when(F.col("k") == 2, F.col("date")), ignorenulls=True).over(X.upto(W.orderBy("date", "k")))).where("k = 1").drop("k")
    x = returns.withColumn("r", F.greatest("daily_return", F.lit(-1.0))).join(seg, "date").where("rebalance is not null").join(weights, ["rebalance", "symbol"])
    w = W.partitionBy("rebalance", "symbol").orderBy("date")
    grown = F.product(1 + F.col("r")).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("value", F.col("weight") * F.coalesce(grown, F.lit(1.0)))
    day = W.partitionBy("date")
    total = F.sum("value").over(day)
    n = F.count(F.lit(1)).over(day)
    x = x.withColumn("held", F.when(total > 0, F.col("value") / total).otherwise(1.0 / n))
    # what a segment ends with, for the turnover of the next one
    ends = x.groupBy("rebalance", "symbol").agg(F.max_by(F.col("value") * (1 + F.col("r")), "date").alias("end"), F.max("weight").alias("w"))
    ends = ends.withColumn("drifted", F.try_divide("end", F.sum("end").over(W.partitionBy("rebalance"))))
    prior = F.coalesce(F.lag("drifted").over(W.partitionBy("symbol").orderBy("rebalance")), F.lit(0.0))
    turn = ends.select("rebalance", "symbol", (0.5 * F.abs(F.col("w") - prior) * cost).alias("cost"))
    first = x.groupBy("rebalance").agg(F.min("date").alias("first"))
    x = x.join(turn, ["rebalance", "symbol"]).join(first, "rebalance")
    x = x.withColumn("cost", F.when(F.col("date") == F.col("first"), F.col("cost")).otherwise(0.0)).withColumn("contribution", F.col("held") * F.col("r"))
    net = F.sum(F.col("contribution") - F.col("cost")).over(day)
    return x.select("date", "symbol", F.col("held").alias("weight"), "contribution", "cost", net.alias("net_return"))


def attribution(contributions: DataFrame) -> DataFrame:
    """Return and variance share of each symbol, and the costs as a row of their own."""
    total = contributions.withColumn("gross", F.sum("contribution").over(W.partitionBy("date")))
    own = total.groupBy("symbol").agg(F.sum("contribution").alias("contribution_to_return"), F.try_divide(F.covar_samp("contribution", "gross"), F.var_samp("gross")).alias("contribution_to_risk"))
    costs = contributions.agg((-F.sum("cost")).alias("contribution_to_return")).select(F.lit("(costs)").alias("symbol"), "contribution_to_return", F.lit(0.0).alias("contribution_to_risk"))
    return own.unionByName(costs)


def tilt_weights(signals: DataFrame, cap: float = 0.4, rounds: int = 10) -> DataFrame:
    """(date, symbol, mu, sigma) -> weights in proportion to mu / sigma over positive mu, none above
    ``cap``; the excess goes to the others in proportion, ``rounds`` times at most. No positive mu: equal."""
    raw = F.when(F.col("mu") > 0, F.col("mu") / F.greatest(F.coalesce("sigma", F.lit(0.01)), F.lit(0.001))).otherwise(0.0)
    g = signals.withColumn("raw", raw).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("symbol", "raw"))).alias("s"))
    v = F.transform("s", lambda x: x["raw"])
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    g = g.withColumns({"v": v, "total": add(v), "n": F.size("s"), "n_pos": F.size(F.filter(v, lambda x: x > 0))})
    g = g.withColumn("w", F.when(F.col("total") > 0, F.transform("v", lambda x: x / F.col("total"))).otherwise(F.transform("v", lambda x: F.lit(1.0) / F.col("n"))))

    def again(w: Column, _: Column) -> Column:
        over = F.aggregate(w, F.lit(0.0), lambda t, x: t + F.greatest(x - cap, F.lit(0.0)))
        room = F.aggregate(w, F.lit(0.0), lambda t, x: t + F.when(x < cap, x).otherwise(0.0))
        return F.when((over <= 1e-15) | (room <= 0), w).otherwise(F.transform(w, lambda x: F.when(x >= cap, F.lit(cap)).otherwise(x + over * x / room)))

    capped = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("w"), again)
    g = g.withColumn("w", F.when((F.col("total") > 0) & (F.col("n_pos") > 2), capped).when((F.col("total") > 0) & (F.col("n_pos") == 2), F.transform("v", lambda x: F.when(x > 0, 0.5).otherwise(0.0))).otherwise(F.col("w")))
    return g.select("date", F.inline(F.arrays_zip(F.transform("s", lambda x: x["symbol"]).alias("symbol"), F.col("w").alias("weight"))))


def uniform(x: Column, seed: int) -> Column:
    """A number from 0 to 1 for a counter: squares of a linear mix modulo a prime, alike in all engines."""
    y = (x * A1 + seed) % P
    y = (y * y + 12345) % P
    y = (y * A2 + seed) % P
    return ((y * y + 54321) % P).cast("double") / P


def bootstrap_indices(spark, n: int, reps: int, seed: int = 7, block: int = 21) -> DataFrame:
    """(rep, t, i): rows of a stationary bootstrap with mean block length ``block``."""
    x = F.col("rep") * n + F.col("t")
    rows = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("t"))
    new = (F.col("t") == 0) | (uniform(x, seed) < 1.0 / block)
    start = F.when(new, F.floor(uniform(x, seed + 1) * n))
    w = X.upto(W.partitionBy("rep").orderBy("t"))
    rows = rows.withColumns({"start": start, "at": F.when(new, F.col("t"))})
    rows = rows.withColumns({"start": F.last("start", ignorenulls=True).over(w), "at": F.last("at", ignorenulls=True).over(w)})
    return rows.select("rep", "t", ((F.col("start") + F.col("t") - F.col("at")) % n).alias("i"))


def resampled(returns: DataFrame, reps: int, seed: int = 7) -> DataFrame:
    """(rep, strategy, daily_return, ...): the same rows for every strategy, so pairs stay paired. ``returns`` has
    every strategy on every date."""
    n = returns.select("date").distinct().count()
    order = returns.select("date").distinct().withColumn("i", (F.row_number().over(W.orderBy("date")) - 1).cast("long"))
    numbered = returns.join(order, "date")
    return bootstrap_indices(returns.sparkSession, n, reps, seed).join(numbered, "i").drop("i", "t", "date")


def interval(stat: DataFrame, keys: list[str], value: str, level: float = 0.9) -> DataFrame:
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return stat.groupBy(*keys).agg(q.alias("q"), F.count(F.lit(1)).alias("n_boot")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_boot")


def p_value(x: Column) -> Column:
    """Two-sided: twice the smaller share of replicates on either side of zero, 1 at most."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return F.coalesce(F.least(F.lit(1.0), 2 * F.least(share(x <= 0), share(x >= 0))), F.lit(1.0))
