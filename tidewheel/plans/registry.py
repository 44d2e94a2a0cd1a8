"""The registered queries: a Spark function and, where SQL can say it, the same query as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..sources import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAILY = """
select *, stddev_samp(daily_return) over (partition by symbol order by date rows between 20 preceding and current row) * sqrt(252.0) as vol_20d,
 avg(close) over (partition by symbol order by date rows between 49 preceding and current row) as ma_50
from (select *, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as daily_return
 from prices where close is not null and not (coalesce(volume, 0) = 0 and asset_class <> 'fx')) s
"""
#: Three stand-in strategies over the weekday universe, one row for each strategy and date.
STRAT = """
select 'long' as window_id, strategy, date, avg(daily_return) as daily_return
from (select case when symbol in ('Brand#1', 'Brand#2', 'Brand#3') then 'equal_weight' when symbol in ('Brand#7', 'Brand#8') then 'tilt' else 'regime' end as strategy, date, daily_return
 from daily where symbol in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#7', 'Brand#8', 'Brand#11', 'Brand#12') and daily_return is not null and extract(dow from date) between 1 and 5) u
group by strategy, date
"""
#: All symbols on one calendar, the weekdays on which anything but fx trades: wealth is carried over the dates between.
ALIGNED = """
select symbol, date, w / nullif(lag(w) over (partition by symbol order by date), 0) - 1 as daily_return
from (select k.symbol, c.date, a.wealth as w from (select distinct symbol from daily) k cross join (select distinct date from daily where asset_class <> 'fx' and extract(dow from date) between 1 and 5) c
 asof left join (select symbol, date, exp(sum(ln(1 + coalesce(daily_return, 0))) over (partition by symbol order by date)) as wealth from daily) a on a.symbol = k.symbol and a.date <= c.date) s
"""
CTES = {"prices": bars.PRICES, "macro": bars.MACRO, "market": bars.MARKET, "annual": bars.ANNUAL, "daily": DAILY, "aligned": ALIGNED, "strat": STRAT}
NEEDS = {"daily": ("prices", "daily"), "aligned": ("prices", "daily", "aligned"), "strat": ("prices", "daily", "strat")}
UNIVERSE = {"equal_weight": ["Brand#1", "Brand#2", "Brand#3"], "tilt": ["Brand#7", "Brand#8"], "regime": ["Brand#11", "Brand#12"]}


def query(sql: str | None = None, needs: tuple[str, ...] = (), name: str | None = None):
    """Registers a function of (spark, sf_dir). ``sql`` may use the tables of CTES named in ``needs``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            order = [t for t in CTES if any(t in NEEDS.get(n, (n,)) for n in needs)]
            head = ", ".join(f"{t} as ({CTES[t].strip()})" for t in order)
            body = sql.strip()
            if head:
                recursive = "recursive " if body.startswith("with recursive ") else ""
                rest = body.removeprefix("with ").removeprefix("recursive ") if body.startswith("with ") else None
                body = f"with {recursive}{head}, {rest}" if rest else f"with {head} {body}"
            SQL[key] = body
        return f

    return add


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily(bars.prices(spark, sf_dir))


def calendar(rows: DataFrame) -> DataFrame:
    """The weekdays on which anything but fx trades."""
    return rows.where("asset_class <> 'fx' and weekday(date) < 5").select("date").distinct()


def strategies(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(window_id, strategy, date, daily_return) of the stand-in strategies, ``without`` some symbols."""
    label = F.lit(None).cast("string")
    for k, symbols in UNIVERSE.items():
        symbols = [s for s in symbols if s not in without]
        label = F.when(F.col("symbol").isin(symbols), F.lit(k)).otherwise(label)
    rows = daily(spark, sf_dir).withColumn("strategy", label).where("strategy is not null and daily_return is not null and weekday(date) < 5")
    return rows.groupBy("strategy", "date").agg(F.avg("daily_return").alias("daily_return")).select(F.lit("long").alias("window_id"), "strategy", "date", "daily_return")


def r(x: Column | str, digits: int = 8) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def d(x: Column | str = "date") -> Column:
    """A date as text."""
    return (F.col(x) if isinstance(x, str) else x).cast("string")
