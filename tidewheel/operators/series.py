"""Operators on keyed series: de-duplication, returns, as-of joins, islands, regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from ..functions.scalars import c


def latest_per_key(df: DataFrame, keys: list[Column | str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def staged(prices: DataFrame) -> DataFrame:
    """Bars with a close that are no phantom bars: zero volume counts outside of fx only, and an
    unknown class with zero volume is dropped."""
    return prices.where("close is not null and not (coalesce(volume, 0) = 0 and asset_class <> 'fx')")


def daily(prices: DataFrame) -> DataFrame:
    """Returns, 21-row volatility and 50-row mean of each symbol's staged bars; one shuffle."""
    w = X.by("symbol")
    out = staged(prices).withColumn("daily_return", X.pct_change("close", w))
    return out.withColumns(
        {
            "vol_20d": F.stddev_samp("daily_return").over(w.rowsBetween(-20, 0)) * F.sqrt(F.lit(252.0)),
            "ma_50": F.avg("close").over(w.rowsBetween(-49, 0)),
        }
    )


def asof_multi(left: DataFrame, right: DataFrame, values: dict[str, Column], time: str = "date", keys: list[str] | None = None) -> DataFrame:
    """Backward as-of lookups in one pass: ``values`` maps names to expressions over ``right``
    that are null where a row doesn't count. Every left row stays. One union, one window.

    Without keys rows are dealt by year: the last values of each year are carried over a table with a row
    for each year, so no task holds the whole spine.
    """
    keys = keys or []
    names = list(values)
    l = left.select("*", F.lit(1).alias("__side"), *(F.lit(None).cast(right.select(v).schema[0].dataType).alias(f"__{n}") for n, v in values.items()))  # noqa: E741
    r = right.select(*keys, c(time).alias(time), F.lit(0).alias("__side"), *(v.alias(f"__{n}") for n, v in values.items()))
    rows = l.unionByName(r, allowMissingColumns=True)
    if keys:
        w = X.upto(W.partitionBy(*keys).orderBy(time, "__side"))
        return rows.withColumns({n: F.last(f"__{n}", ignorenulls=True).over(w) for n in names}).where("__side = 1").drop("__side", *(f"__{n}" for n in names))
    rows = rows.withColumn("__year", F.year(time))
    ends = r.withColumn("__year", F.year(time)).groupBy("__year").agg(*(F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), c(time))).alias(f"__e_{n}") for n in names))
    years = rows.select("__year").distinct().join(ends, "__year", "left")
    past = W.orderBy("__year").rowsBetween(W.unboundedPreceding, -1)
    carried = years.select("__year", *(F.last(f"__e_{n}", ignorenulls=True).over(past).alias(f"__c_{n}") for n in names))
    w = X.upto(W.partitionBy("__year").orderBy(time, "__side"))
    found = rows.withColumns({n: F.last(f"__{n}", ignorenulls=True).over(w) for n in names}).where("__side = 1").join(carried, "__year", "left")
    return found.withColumns({n: F.coalesce(n, f"__c_{n}") for n in names}).drop("__side", "__year", *(f"__{n}" for n in names), *(f"__c_{n}" for n in names))


def ntile_labels(df: DataFrame, value: str, keys: list[str], labels: list[str], tie: str = "date") -> Column:
    n = F.ntile(len(labels)).over(W.partitionBy(*keys).orderBy(value, tie))
    return F.element_at(F.array(*map(F.lit, labels)), n)


def quantile_labels(df: DataFrame, key: str = "symbol", value: str = "vol_20d", tie: str = "date", labels: tuple[str, str, str] = ("Low", "Medium", "High")) -> DataFrame:
    """Regimes by rank within the key; keys with fewer than 3 rows are dropped, and if no key has
    3 rows all rows are in the middle."""
    w = W.partitionBy(key)
    k = F.row_number().over(w.orderBy(value, tie))
    n = F.count(F.lit(1)).over(w)
    rows = df.where(c(value).isNotNull()).withColumns({"__k": k, "__n": n})
    label = F.when(3 * (F.col("__k") - 1) < F.col("__n") - 1, labels[0]).when(3 * (F.col("__k") - 1) < 2 * (F.col("__n") - 1), labels[1]).otherwise(labels[2])
    most = rows.agg(F.max("__n").alias("__most"))
    rows = rows.crossJoin(F.broadcast(most)).where("__n >= 3 or __most < 3")  # one row
    return rows.withColumn("regime", F.when(F.col("__most") < 3, F.lit(labels[1])).otherwise(label)).drop("__k", "__n", "__most")


def runs(df: DataFrame, keys: list[str], label: str, time: str = "date") -> DataFrame:
    """Spans of equal labels: label, start, stop, rows."""
    w = W.partitionBy(*keys).orderBy(time)
    new = F.coalesce((c(label) != F.lag(label).over(w)).cast("int"), F.lit(1))
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(X.upto(w)))
    return marked.groupBy(*keys, "__run", label).agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count(F.lit(1)).alias("n_rows")).drop("__run")


def boundaries(df: DataFrame, keys: list[str], label: str, time: str = "date") -> DataFrame:
    """Rows whose label differs from the row before; the first row is none."""
    w = W.partitionBy(*keys).orderBy(time)
    return df.withColumn("previous", F.lag(label).over(w)).where(c("previous").isNotNull() & (c("previous") != c(label)))


def thinned(events: DataFrame, keys: list[str], gap: int, time: str = "date") -> DataFrame:
    """Greedy thinning of dated events, the earliest first: an event stays if it is ``gap`` days or more after the last one that stayed.

    Which events stay depends on all before, so a key's dates are folded in order, as day numbers; only dates are gathered, and only of events (change points,
    not rows). Of one day's events only
    the first can stay, so equal days are folded once. ``gap`` 0 keeps everything.
    """
    if gap <= 0:
        return events
    day = F.datediff(c(time), F.lit("1970-01-01").cast("date"))
    days = events.select(*keys, day.alias("__day")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("__day")).alias("days"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        stays = s["last"].isNull() | (x - s["last"] >= gap)
        return F.struct(F.when(stays, x).otherwise(s["last"]).alias("last"), F.when(stays, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    kept = days.select(*keys, F.explode(F.aggregate("days", start, step, lambda s: s["kept"])).alias("__day"))
    first = F.row_number().over(W.partitionBy(*keys, "__day").orderBy(time))
    marked = events.withColumn("__day", day)
    return marked.join(kept, [*keys, "__day"], "left_semi").withColumn("__nth", first).where("__nth = 1").drop("__day", "__nth")


def pairs(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(a, b, time, x, y) for keys a < b that have a value at the same time."""
    own = df.where(c(value).isNotNull())
    x = own.select(c(key).alias("a"), time, c(value).alias("x"))
    y = own.select(c(key).alias("b"), time, c(value).alias("y"))
    return x.join(y, time).where("a < b")


def correlations(df: DataFrame, key: str = "symbol", time: str = "date", value: str = "daily_return", least: int = 30) -> DataFrame:
    """Pairwise-complete Pearson correlation of keys with ``least`` common times at least."""
    got = pairs(df, key, time, value).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("correlation"))
    return got.where(F.col("n") >= least)


def decayed(df: DataFrame, key: str, term: str, decay: float, order: str, out: str) -> DataFrame:
    """``out``: y_t = decay * y_{t-1} + term_t for each key, without a loop over rows.

    Prefix sums within blocks whose powers of ``decay`` doubles can hold; the ends of blocks form the same recurrence
    with decay ** block, 512 times shorter, until one block forgets the one before it.
    """
    block = max(1, min(512, int(230 / -math.log(decay)))) if decay > 0 else 1
    w = W.partitionBy(key).orderBy(order)
    names = [f"__{n}_{out}" for n in ("i", "b", "k", "p", "carry")]
    i, b, k, p, carry = names
    rows = df.withColumn(i, F.row_number().over(w) - 1).withColumns({b: F.floor(F.col(i) / block), k: F.col(i) % block})
    inner = X.upto(W.partitionBy(key, b).orderBy(order))
    rows = rows.withColumn(p, F.sum(c(term) * F.pow(F.lit(decay), -F.col(k))).over(inner) * F.pow(F.lit(decay), F.col(k)))
    ends = rows.groupBy(key, b).agg(F.max_by(p, k).alias("__end"))
    y = "__end"
    if decay**block > 1e-18:
        ends, y = decayed(ends, key, "__end", decay**block, b, f"{out}_"), f"{out}_"
    ends = ends.select(key, b, F.lag(y, 1, 0.0).over(W.partitionBy(key).orderBy(b)).alias(carry))
    rows = rows.join(ends, [key, b])
    return rows.withColumn(out, F.col(p) + F.pow(F.lit(decay), F.col(k) + 1) * F.col(carry)).drop(*names)


def ewma(df: DataFrame, key: str, value: str, decay: float = 0.94, time: str = "date") -> DataFrame:
    """e_t = decay * e_{t-1} + (1 - decay) * x_t with e_0 = x_0, for 0 < decay < 1."""
    first = F.row_number().over(W.partitionBy(key).orderBy(time)) == 1
    rows = df.withColumn("__term", F.when(first, c(value)).otherwise((1 - decay) * c(value)))
    return decayed(rows, key, "__term", decay, time, "ewma").drop("__term")
