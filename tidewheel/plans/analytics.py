"""Aggregations, windows, top-k and reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from ..operators import performance as P
from ..operators import series
from ..sources import bars
from .registry import d, daily, query, r, strategies

D8 = lambda *names: ", ".join(f"round({n}, 8) as {n}" for n in names)


@query("select distinct symbol, asset_class from prices", ("prices",))
def distinct_dim(spark, sf_dir):
    return bars.prices(spark, sf_dir).select("symbol", "asset_class").distinct()


@query("select window_id, strategy, cast(min(date) as varchar) as start_date, cast(max(date) as varchar) as end_date from strat where daily_return <> 0 group by 1, 2", ("strat",))
def window_bounds(spark, sf_dir):
    return strategies(spark, sf_dir).where("daily_return <> 0").groupBy("window_id", "strategy").agg(d(F.min("date")).alias("start_date"), d(F.max("date")).alias("end_date"))


REGIMES = "select date, case ntile(3) over (order by vol_20d, date) when 1 then 'Low' when 2 then 'Medium' else 'High' end as regime from daily where symbol = 'Brand#1' and vol_20d is not null"


def regimes(spark, sf_dir):
    b = daily(spark, sf_dir).where("symbol = 'Brand#1' and vol_20d is not null")
    return b.select("date", series.ntile_labels(b, "vol_20d", ["symbol"], ["Low", "Medium", "High"]).alias("regime"))


@query(
    f"""select window_id, strategy, regime, n_days, round(n_days * 1.0 / sum(n_days) over (partition by window_id, strategy), 8) as share, round(ann_return, 8) as ann_return, round(ann_vol, 8) as ann_vol,
 round(ann_return / nullif(ann_vol, 0), 6) as sharpe from (select window_id, strategy, regime, count(*) as n_days, avg(daily_return) * 252 as ann_return, stddev_samp(daily_return) * sqrt(252.0) as ann_vol
 from strat s join ({REGIMES}) g on g.date = s.date group by 1, 2, 3) x""",
    ("strat",),
)
def regime_performance(spark, sf_dir):
    got = P.regime_performance(strategies(spark, sf_dir), regimes(spark, sf_dir))
    return got.select("window_id", "strategy", "regime", "n_days", r("share").alias("share"), r("ann_return").alias("ann_return"), r("ann_vol").alias("ann_vol"), r("sharpe", 6).alias("sharpe"))


@query("select event_type, round(count(*) * 1.0 / sum(count(*)) over (), 8) as share from events group by event_type")
def share_of_total(spark, sf_dir):
    got = bars.scan(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return got.select("event_type", r(F.col("n").cast("double") / F.sum("n").over(W.partitionBy())).alias("share"))


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 5")
def having_count(spark, sf_dir):
    return bars.scan(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("select strategy, round(sum(case when daily_return > 0 then daily_return else 0 end), 8) as gains, round(max(daily_return), 8) as best from strat group by strategy", ("strat",))
def conditional_sum_max(spark, sf_dir):
    return strategies(spark, sf_dir).groupBy("strategy").agg(r(F.sum(F.when(F.col("daily_return") > 0, F.col("daily_return")).otherwise(0.0))).alias("gains"), r(F.max("daily_return")).alias("best"))


@query("select symbol, asset_class, count(*) as n, cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date from prices group by 1, 2", ("prices",))
def asset_universe(spark, sf_dir):
    return bars.prices(spark, sf_dir).groupBy("symbol", "asset_class").agg(F.count(F.lit(1)).alias("n"), d(F.min("date")).alias("first_date"), d(F.max("date")).alias("last_date"))


@query("select 'prices' as mart, count(*) as n, cast(max(date) as varchar) as latest from prices union all select 'macro', count(*), cast(max(date) as varchar) from macro union all select 'annual', count(*), cast(max(year) as varchar) from annual", ("prices", "macro", "annual"))
def mart_summary(spark, sf_dir):
    one = lambda df, name, t: df.agg(F.count(F.lit(1)).alias("n"), F.max(t).cast("string").alias("latest")).select(F.lit(name).alias("mart"), "n", "latest")
    return one(bars.prices(spark, sf_dir), "prices", "date").unionByName(one(bars.macro(spark, sf_dir), "macro", "date")).unionByName(one(bars.annual(spark, sf_dir), "annual", "year"))


AS_OF = "1998-12-31"


@query(
    f"""select series_id, cast(latest as varchar) as latest, cast((select count(*) from range(1, 20000) g(k) where k <= date '{AS_OF}' - latest and isodow(latest + cast(k as integer)) < 6) as bigint) as business_days,
 case when (select count(*) from range(1, 20000) g(k) where k <= date '{AS_OF}' - latest and isodow(latest + cast(k as integer)) < 6) <= 5 then 'fresh' else 'stale' end as state
 from (select series_id, max(date) as latest from macro where date <= date '{AS_OF}' and extract(month from date) <> case series_id when 'DGS2' then 12 else 0 end group by 1) x""",
    ("macro",),
)
def source_freshness(spark, sf_dir):
    """Business days since the latest value, in closed form; the as-of day is a parameter."""
    m = bars.macro(spark, sf_dir).where(f"date <= date '{AS_OF}'").where((F.col("series_id") != "DGS2") | (F.month("date") != 12))
    latest = m.groupBy("series_id").agg(F.max("date").alias("latest"))
    # weekdays up to a day: full weeks and the rest, counted from a Monday
    upto = lambda x: (lambda k: F.floor(k / 7) * 5 + F.least(k % 7, F.lit(4)) + 1)(F.date_diff(x, F.lit("1990-01-01").cast("date")))
    n = (upto(F.lit(AS_OF).cast("date")) - upto(F.col("latest"))).cast("bigint")
    return latest.select("series_id", d("latest").alias("latest"), n.alias("business_days"), F.when(n <= 5, "fresh").otherwise("stale").alias("state"))


@query(
    """select symbol, round(last_close / first_close - 1, 8) as total_return, round(sd * sqrt(252.0), 8) as vol from (select symbol, arg_max(close, date) as last_close, arg_min(close, date) as first_close,
 stddev_samp(daily_return) as sd, count(*) as n from daily group by symbol) x where n >= 2 and first_close <> 0""",
    ("daily",),
)
def cross_asset_leaderboard(spark, sf_dir):
    got = daily(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("a"), F.min_by("close", "date").alias("b"), F.stddev_samp("daily_return").alias("sd"), F.count(F.lit(1)).alias("n"))
    return got.where("n >= 2 and b <> 0").select("symbol", r(F.col("a") / F.col("b") - 1).alias("total_return"), r(F.col("sd") * F.sqrt(F.lit(252.0))).alias("vol"))


CORR = "select x.symbol as a, y.symbol as b, count(*) as n, corr(x.daily_return, y.daily_return) as correlation from daily x join daily y on x.date = y.date and x.symbol < y.symbol where x.daily_return is not null and y.daily_return is not null group by 1, 2 having count(*) >= 30"


@query(f"select a, b, n, round(correlation, 6) as correlation from ({CORR}) z", ("daily",))
def correlation_matrix(spark, sf_dir):
    return series.correlations(daily(spark, sf_dir)).select("a", "b", "n", r("correlation", 6).alias("correlation"))


@query(f"select arg_max(a || '/' || b, correlation) as highest, arg_min(a || '/' || b, correlation) as lowest, round(max(correlation), 6) as hi, round(min(correlation), 6) as lo from ({CORR}) z", ("daily",))
def correlation_extremes(spark, sf_dir):
    c = series.correlations(daily(spark, sf_dir)).withColumn("pair", F.concat_ws("/", "a", "b"))
    return c.agg(F.max_by("pair", "correlation").alias("highest"), F.min_by("pair", "correlation").alias("lowest"), r(F.max("correlation"), 6).alias("hi"), r(F.min("correlation"), 6).alias("lo"))


WEALTH = "select *, exp(sum(ln(1 + daily_return)) over (partition by strategy order by date)) as wealth from strat"
DRAW = f"select *, wealth - 1 as cumulative_return, wealth / max(wealth) over (partition by strategy order by date) - 1 as drawdown from ({WEALTH}) w"


@query(f"select strategy, cast(date as varchar) as date, round(cumulative_return, 6) as cumulative_return, round(drawdown, 6) as drawdown from ({DRAW}) x", ("strat",))
def drawdown(spark, sf_dir):
    return P.drawdowns(strategies(spark, sf_dir), ["strategy"]).select("strategy", d().alias("date"), r("cumulative_return", 6).alias("cumulative_return"), r("drawdown", 6).alias("drawdown"))


@query(f"select strategy, cast(date as varchar) as date, round(cumulative_return, 6) as cumulative_return from ({DRAW}) x", ("strat",))
def cumulative_return(spark, sf_dir):
    return P.drawdowns(strategies(spark, sf_dir), ["strategy"]).select("strategy", d().alias("date"), r("cumulative_return", 6).alias("cumulative_return"))


@query(f"select strategy, round(arg_max(cumulative_return, date), 6) as total, round(min(drawdown), 6) as max_drawdown, round(stddev_samp(daily_return) * sqrt(252.0), 8) as vol from ({DRAW}) x group by strategy", ("strat",))
def portfolio_summary(spark, sf_dir):
    return P.drawdowns(strategies(spark, sf_dir), ["strategy"]).groupBy("strategy").agg(r(F.max_by("cumulative_return", "date"), 6).alias("total"), r(F.min("drawdown"), 6).alias("max_drawdown"), r(P.annual_vol("daily_return")).alias("vol"))


@query("select strategy, round(case when count(*) = 0 then 0 else exp(sum(ln(1 + daily_return)) * 252 / count(*)) - 1 end, 6) as cagr from strat group by strategy", ("strat",))
def annualized_return(spark, sf_dir):
    return strategies(spark, sf_dir).groupBy("strategy").agg(r(P.annual_return("daily_return"), 6).alias("cagr"))


@query("select symbol, round(case when count(daily_return) > 1 then stddev_samp(daily_return) * sqrt(252.0) else 0 end, 8) as vol from daily group by symbol", ("daily",))
def annualized_vol(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("symbol").agg(r(P.annual_vol("daily_return")).alias("vol"))


@query("select symbol, round(case when count(daily_return) < 2 or stddev_samp(daily_return) = 0 then 0 else (avg(daily_return) - 0.02 / 252) / nullif(stddev_samp(daily_return), 0) * sqrt(252.0) end, 6) as sharpe from daily group by symbol", ("daily",))
def sharpe(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("symbol").agg(r(P.sharpe("daily_return", 0.02), 6).alias("sharpe"))


@query(f"select strategy, round(min(drawdown), 6) as max_drawdown, round((exp(sum(ln(1 + daily_return)) * 252 / count(*)) - 1) / nullif(abs(min(drawdown)), 0), 5) as calmar from ({DRAW}) x group by strategy", ("strat",))
def max_drawdown(spark, sf_dir):
    got = P.drawdowns(strategies(spark, sf_dir), ["strategy"]).groupBy("strategy").agg(F.min("drawdown").alias("m"), P.annual_return("daily_return").alias("g"))
    return got.select("strategy", r("m", 6).alias("max_drawdown"), r(F.try_divide("g", F.abs("m")), 5).alias("calmar"))


@query("select symbol, round(s / count(*) over (), 8) as contribution, round(1.0 / count(*) over (), 8) as risk_share from (select symbol, sum(daily_return) as s from daily where daily_return is not null group by symbol) x", ("daily",))
def attribution_equal_weight(spark, sf_dir):
    rows = daily(spark, sf_dir).where("daily_return is not null")
    got = rows.groupBy("symbol").agg(F.sum("daily_return").alias("s"))
    n = F.count(F.lit(1)).over(W.partitionBy())
    return got.select("symbol", r(F.col("s") / n).alias("contribution"), r(F.lit(1.0) / n).alias("risk_share"))


PRED = "select symbol, date, lag(daily_return) over (partition by symbol order by date) as pred, daily_return as actual, vol_20d from daily"


def predictions(spark, sf_dir):
    """Yesterday's return as the forecast of today's."""
    return daily(spark, sf_dir).select("symbol", "date", F.lag("daily_return").over(X.by("symbol")).alias("pred"), F.col("daily_return").alias("actual"), "vol_20d")


@query(
    f"""select symbol, round(avg(case when sign(pred) = sign(actual) and actual <> 0 then 1.0 else 0.0 end), 8) as accuracy, round(greatest(avg(case when actual > 0 then 1.0 else 0.0 end), avg(case when actual < 0 then 1.0 else 0.0 end)), 8) as baseline
 from ({PRED}) p where pred is not null and actual is not null group by symbol""",
    ("daily",),
)
def directional_accuracy(spark, sf_dir):
    hit = F.when((F.signum("pred") == F.signum("actual")) & (F.col("actual") != 0), 1.0).otherwise(0.0)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return predictions(spark, sf_dir).where("pred is not null and actual is not null").groupBy("symbol").agg(r(F.avg(hit)).alias("accuracy"), r(F.greatest(share(F.col("actual") > 0), share(F.col("actual") < 0))).alias("baseline"))


@query(
    f"""select p.symbol, case when vol_20d <= q1 then 'Low' when vol_20d <= q2 then 'Medium' else 'High' end as regime, count(*) as n, round(avg(case when sign(pred) = sign(actual) and actual <> 0 then 1.0 else 0.0 end), 8) as accuracy
 from ({PRED}) p join (select symbol, quantile_cont(vol_20d, 1.0 / 3) as q1, quantile_cont(vol_20d, 2.0 / 3) as q2 from ({PRED}) z where pred is not null and actual is not null and vol_20d is not null group by symbol having count(*) >= 6) q on p.symbol = q.symbol
 where pred is not null and actual is not null and vol_20d is not null group by 1, 2""",
    ("daily",),
)
def regime_directional_accuracy(spark, sf_dir):
    p = predictions(spark, sf_dir).where("pred is not null and actual is not null and vol_20d is not null")
    q = p.groupBy("symbol").agg(F.percentile("vol_20d", F.array(F.lit(1.0 / 3), F.lit(2.0 / 3))).alias("q"), F.count(F.lit(1)).alias("m")).where("m >= 6")
    label = F.when(F.col("vol_20d") <= F.col("q")[0], "Low").when(F.col("vol_20d") <= F.col("q")[1], "Medium").otherwise("High")
    hit = F.when((F.signum("pred") == F.signum("actual")) & (F.col("actual") != 0), 1.0).otherwise(0.0)
    return p.join(q, "symbol").groupBy("symbol", label.alias("regime")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(hit)).alias("accuracy"))


@query(
    f"""select symbol, round(avg(s) / nullif(stddev_pop(s), 0) * sqrt(252.0 / 5), 6) as sharpe from (select symbol, sign(pred) * actual as s, row_number() over (partition by symbol order by date) - 1 as i from ({PRED}) p
 where pred is not null and actual is not null) x where i % 5 = 0 group by symbol""",
    ("daily",),
)
def directional_sharpe(spark, sf_dir):
    p = predictions(spark, sf_dir).where("pred is not null and actual is not null")
    p = p.select("symbol", (F.signum("pred") * F.col("actual")).alias("s"), (F.row_number().over(X.by("symbol")) - 1).alias("i")).where("i % 5 = 0")
    return p.groupBy("symbol").agg(r(F.avg("s") / F.nullif(F.stddev_pop("s"), F.lit(0.0)) * F.sqrt(F.lit(252.0 / 5)), 6).alias("sharpe"))


@query(
    f"""select symbol, round(1 - sum(power(actual - pred, 2)) / nullif(sum(power(actual - m, 2)), 0), 6) as r2, round(sign(corr(pred, actual)) * power(corr(pred, actual), 2), 6) as ic_signed_sq
 from (select *, avg(actual) over (partition by symbol) as m from ({PRED}) p where pred is not null and actual is not null) x group by symbol having count(*) >= 3""",
    ("daily",),
)
def r2(spark, sf_dir):
    p = predictions(spark, sf_dir).where("pred is not null and actual is not null")
    p = p.withColumn("m", F.avg("actual").over(W.partitionBy("symbol")))
    sq = lambda c: F.sum(F.pow(F.col("actual") - F.col(c), F.lit(2.0)))
    got = p.groupBy("symbol").agg(sq("pred").alias("a"), sq("m").alias("b"), F.corr("pred", "actual").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return got.select("symbol", r(1 - F.try_divide("a", "b"), 6).alias("r2"), r(F.signum("c") * F.pow("c", F.lit(2.0)), 6).alias("ic_signed_sq"))


@query(
    f"""select symbol, round(avg(case when i % 5 = 0 then s end) * 252 / 5, 8) as alpha, round(avg(abs(pred - prev)), 8) as turnover, round(avg(case when i % 5 = 0 then s end) / nullif(stddev_pop(case when i % 5 = 0 then s end), 0) * sqrt(252.0 / 5) - 0.0005 * avg(abs(pred - prev)), 6) as turnover_adjusted_sharpe
 from (select *, sign(pred) * actual as s, lag(pred) over (partition by symbol order by date) as prev, row_number() over (partition by symbol order by date) - 1 as i from ({PRED}) p where pred is not null and actual is not null) x group by symbol""",
    ("daily",),
)
def annualised_alpha(spark, sf_dir):
    """Alpha and Sharpe ratio less the cost of turning, of every fifth day: a forecast's horizon is its stride."""
    w = X.by("symbol")
    p = predictions(spark, sf_dir).where("pred is not null and actual is not null").withColumns({"turned": F.abs(F.col("pred") - F.lag("pred").over(w)), "i": F.row_number().over(w) - 1})
    s = F.when(F.col("i") % 5 == 0, F.signum("pred") * F.col("actual"))
    sharpe = F.try_divide(F.avg(s), F.stddev_pop(s)) * F.sqrt(F.lit(252.0 / 5))
    return p.groupBy("symbol").agg(r(F.avg(s) * 252 / 5).alias("alpha"), r(F.avg("turned")).alias("turnover"), r(sharpe - 0.0005 * F.avg("turned"), 6).alias("turnover_adjusted_sharpe"))


VOLS = "select symbol, date, lag(vol_20d) over (partition by symbol order by date) / sqrt(252.0) as p, vol_20d / sqrt(252.0) as a from daily"


def vols(spark, sf_dir):
    day = F.sqrt(F.lit(252.0))
    return daily(spark, sf_dir).select("symbol", "date", (F.lag("vol_20d").over(X.by("symbol")) / day).alias("p"), (F.col("vol_20d") / day).alias("a")).where("p is not null and a is not null")


@query(f"select symbol, round(1 - sum(power(a - p, 2)) / nullif(sum(power(a - m, 2)), 0), 6) as oos_r2 from (select *, avg(a) over (partition by symbol) as m from ({VOLS}) v where p is not null and a is not null) x group by symbol", ("daily",))
def oos_r2(spark, sf_dir):
    v = vols(spark, sf_dir).withColumn("m", F.avg("a").over(W.partitionBy("symbol")))
    sq = lambda c: F.sum(F.pow(F.col("a") - F.col(c), F.lit(2.0)))
    return v.groupBy("symbol").agg(r(1 - F.try_divide(sq("p"), sq("m")), 6).alias("oos_r2"))


RHO = "power(greatest(p, 0.002), 2) / power(greatest(a, 0.002), 2)"


@query(f"select symbol, round(avg({RHO} - ln({RHO}) - 1), 8) as qlike from ({VOLS}) v where p is not null and a is not null group by symbol", ("daily",))
def qlike(spark, sf_dir):
    rho = F.pow(F.greatest("p", F.lit(0.002)), F.lit(2.0)) / F.pow(F.greatest("a", F.lit(0.002)), F.lit(2.0))
    return vols(spark, sf_dir).groupBy("symbol").agg(r(F.avg(rho - F.ln(rho) - 1)).alias("qlike"))



# --- windows -------------------------------------------------------------------------------------


@query("select event_id, event_type, user_id from (select *, row_number() over (partition by event_type, cast(ts as date) order by ts desc, event_id desc) as rn from events) e where rn = 1")
def dedup_latest(spark, sf_dir):
    e = bars.scan(spark, sf_dir, "events")
    return series.latest_per_key(e, ["event_type", F.to_date("ts")], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "event_type", "user_id")


@query("select symbol, cast(date as varchar) as date, round(close, 8) as close from (select *, row_number() over (partition by symbol order by date desc) as rn from prices) p where rn <= 70", ("prices",))
def top_n_per_key(spark, sf_dir):
    return series.latest_per_key(bars.prices(spark, sf_dir), ["symbol"], [F.col("date").desc()], 70).select("symbol", d().alias("date"), r("close").alias("close"))


@query("select user_id, arg_max(event_type, event_id) as last_type, arg_min(event_type, event_id) as first_type from events group by user_id")
def dedup_keep_last(spark, sf_dir):
    return bars.scan(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"))


@query("select symbol, cast(date as varchar) as date, round(daily_return, 8) as daily_return from daily", ("daily",))
def daily_return(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r("daily_return").alias("daily_return"))


@query("select series_id, cast(date as varchar) as date, value, value - lag(value) over (partition by series_id order by date) as change from macro", ("macro",))
def period_change(spark, sf_dir):
    return bars.macro(spark, sf_dir).select("series_id", d().alias("date"), "value", X.change("value", X.by("series_id")).alias("change"))


@query("select symbol, cast(date as varchar) as date, round(vol_20d, 8) as vol_20d from daily", ("daily",))
def vol_20d(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r("vol_20d").alias("vol_20d"))


@query("select symbol, cast(date as varchar) as date, round(ma_50 + 1e-9, 6) as ma_50 from daily", ("daily",))
def ma_50(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(F.col("ma_50") + 1e-9, 6).alias("ma_50"))  # off the ties


@query("select strategy, cast(date as varchar) as date, round(avg(daily_return) over w / nullif(stddev_samp(daily_return) over w, 0) * sqrt(252.0), 6) as rolling_sharpe from strat window w as (partition by strategy order by date rows between 251 preceding and current row)", ("strat",))
def rolling_sharpe_252(spark, sf_dir):
    w = X.last_n(X.by("strategy"), 252)
    s = F.avg("daily_return").over(w) / F.nullif(F.stddev_samp("daily_return").over(w), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    return strategies(spark, sf_dir).select("strategy", d().alias("date"), r(s, 6).alias("rolling_sharpe"))


@query(f"select cast(date as varchar) as date, regime from ({REGIMES}) g", ("daily",))
def ntile_terciles(spark, sf_dir):
    return regimes(spark, sf_dir).select(d().alias("date"), "regime")


QCUT = """select symbol, date, case when 3 * (k - 1) < n - 1 then 'Low' when 3 * (k - 1) < 2 * (n - 1) then 'Medium' else 'High' end as regime
 from (select symbol, date, row_number() over (partition by symbol order by vol_20d, date) as k, count(*) over (partition by symbol) as n from daily where vol_20d is not null) x where n >= 3"""


@query(f"select symbol, cast(date as varchar) as date, regime from ({QCUT}) q", ("daily",))
def label_regimes(spark, sf_dir):
    return series.quantile_labels(daily(spark, sf_dir)).select("symbol", d().alias("date"), "regime")


@query(
    """select symbol, cast(date as varchar) as date, round(exp(sum(ln(1 + x)) over (partition by symbol order by date)) - 1, 6) as rebased from (select symbol, date, case when row_number() over (partition by symbol order by date) = 1 then 0 else coalesce(daily_return, 0) end as x
 from daily where date >= date '1998-01-01') y""",
    ("daily",),
)
def rebased_performance(spark, sf_dir):
    w = X.by("symbol")
    x = F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.coalesce("daily_return", F.lit(0.0)))
    rows = daily(spark, sf_dir).where("date >= date '1998-01-01'").select("symbol", "date", x.alias("x"))
    return rows.select("symbol", d().alias("date"), r(X.wealth("x", w) - 1, 6).alias("rebased"))


@query(f"select strategy, cast(date as varchar) as date, round((1 + cumulative_return) / (1 + first_value(cumulative_return) over (partition by strategy order by date)) - 1, 6) as rebased from ({DRAW}) x where date >= date '1998-01-01'", ("strat",))
def rebase_cumulative(spark, sf_dir):
    rows = P.drawdowns(strategies(spark, sf_dir), ["strategy"]).where("date >= date '1998-01-01'")
    first = F.first("cumulative_return").over(X.upto(X.by("strategy")))
    return rows.select("strategy", d().alias("date"), r((1 + F.col("cumulative_return")) / (1 + first) - 1, 6).alias("rebased"))


@query(
    """select symbol, cast(date as varchar) as date, round(case when count(daily_return) over w >= 20 then avg(daily_return) over w end, 8) as mean_20, round(case when count(daily_return) over w >= 20 then stddev_samp(daily_return) over w end, 8) as std_20
 from daily window w as (partition by symbol order by date rows between 19 preceding and current row)""",
    ("daily",),
)
def rolling_mean(spark, sf_dir):
    w = X.last_n(X.by("symbol"), 20)
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(X.rolling(F.avg, "daily_return", w, 20)).alias("mean_20"), r(X.rolling(F.stddev_samp, "daily_return", w, 20)).alias("std_20"))


@query("select symbol, cast(date as varchar) as date, " + ", ".join(f"round(lag(daily_return, {k}) over (partition by symbol order by date), 8) as lag_{k}" for k in (1, 2, 3, 5)) + " from daily", ("daily",))
def lag_features(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), *(r(F.lag("daily_return", k).over(X.by("symbol"))).alias(f"lag_{k}") for k in (1, 2, 3, 5)))


@query("select symbol, cast(date as varchar) as date, round(lead(daily_return) over o, 8) as next_return, round(case when count(daily_return) over w = 5 then sum(daily_return) over w end, 8) as next_5 from daily window o as (partition by symbol order by date), w as (partition by symbol order by date rows between 1 following and 5 following)", ("daily",))
def forward_target(spark, sf_dir):
    o = X.by("symbol")
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(F.lead("daily_return").over(o)).alias("next_return"), r(X.rolling(F.sum, "daily_return", o.rowsBetween(1, 5), 5)).alias("next_5"))


@query("select symbol, cast(date as varchar) as date, round(case when count(vol_20d) over w = 5 then avg(vol_20d) over w end, 8) as next_vol from daily window w as (partition by symbol order by date rows between 1 following and 5 following)", ("daily",))
def forward_vol_target(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(X.rolling(F.avg, "vol_20d", X.by("symbol").rowsBetween(1, 5), 5)).alias("next_vol"))


@query(
    """select symbol, cast(date as varchar) as date, round(lag(z) over (partition by symbol order by date), 6) as z from (select symbol, date, case when count(daily_return) over w >= 20 then (daily_return - avg(daily_return) over w) / nullif(stddev_samp(daily_return) over w, 0) end as z
 from daily window w as (partition by symbol order by date rows between 19 preceding and current row)) x""",
    ("daily",),
)
def rolling_zscore(spark, sf_dir):
    w = X.by("symbol")
    rows = daily(spark, sf_dir).withColumn("z", X.zscore("daily_return", X.last_n(w, 20), 20))
    return rows.select("symbol", d().alias("date"), r(F.lag("z").over(w), 6).alias("z"))


@query(
    """select symbol, cast(date as varchar) as date, round(lag(c) over (partition by symbol order by date), 6) as autocorr from (select symbol, date, case when count(l) over w >= 19 and count(daily_return) over w >= 19 then corr(l, daily_return) over w end as c
 from (select symbol, date, daily_return, lag(daily_return) over (partition by symbol order by date) as l from daily) x window w as (partition by symbol order by date rows between 18 preceding and current row)) y""",
    ("daily",),
)
def rolling_autocorr(spark, sf_dir):
    w = X.by("symbol")
    f = X.last_n(w, 19)
    rows = daily(spark, sf_dir).withColumn("l", F.lag("daily_return").over(w))
    rows = rows.withColumn("c", X.enough(X.enough(F.corr("l", "daily_return").over(f), "l", f, 19), "daily_return", f, 19))
    return rows.select("symbol", d().alias("date"), r(F.lag("c").over(w), 6).alias("autocorr"))


@query(
    """select symbol, cast(date as varchar) as date, round(case when count(b) over w >= 10 and count(daily_return) over w >= 10 then corr(daily_return, b) over w end, 6) as c from (select p.symbol, p.date, p.daily_return, q.daily_return as b from daily p
 join daily q on q.date = p.date and q.symbol = 'Brand#1' where p.symbol <> 'Brand#1') x window w as (partition by symbol order by date rows between 19 preceding and current row)""",
    ("daily",),
)
def rolling_corr(spark, sf_dir):
    x = daily(spark, sf_dir)
    b = x.where("symbol = 'Brand#1'").select("date", F.col("daily_return").alias("b"))
    rows = x.where("symbol <> 'Brand#1'").join(b, "date")
    f = X.last_n(X.by("symbol"), 20)
    c = X.enough(X.enough(F.corr("daily_return", "b").over(f), "b", f, 10), "daily_return", f, 10)
    return rows.select("symbol", d().alias("date"), r(c, 6).alias("c"))


@query(
    """select symbol, cast(date as varchar) as date, round(case when count(daily_return) over w >= 10 then skewness(daily_return) over w end, 5) as skew, round(case when count(daily_return) over w >= 10 then kurtosis(daily_return) over w end, 4) as kurt,
 round(case when count(daily_return) over w >= 10 then max(daily_return) over w end, 8) as top from daily window w as (partition by symbol order by date rows between 19 preceding and current row)""",
    ("daily",),
)
def rolling_skew(spark, sf_dir):
    f = X.last_n(X.by("symbol"), 20)
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(X.skew("daily_return", f, 10), 5).alias("skew"), r(X.kurt("daily_return", f, 10), 4).alias("kurt"), r(X.rolling(F.max, "daily_return", f, 10)).alias("top"))


@query("select symbol, cast(date as varchar) as date, round(case when count(close) over w >= 20 then median(close) over w end, 8) as med from daily window w as (partition by symbol order by date rows between 59 preceding and current row)", ("daily",))
def rolling_median(spark, sf_dir):
    f = X.last_n(X.by("symbol"), 60)
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(X.rolling(lambda x: F.percentile(x, F.lit(0.5)), "close", f, 20)).alias("med"))


@query("select series_id, cast(date as varchar) as date, last_value(v ignore nulls) over (partition by series_id order by date rows between unbounded preceding and current row) as value from (select series_id, date, case when extract(day from date) % 3 = 0 then value end as v from macro) m", ("macro",))
def ffill(spark, sf_dir):
    m = bars.macro(spark, sf_dir).withColumn("v", F.when(F.dayofmonth("date") % 3 == 0, F.col("value")))
    return m.select("series_id", d().alias("date"), X.ffill("v", X.by("series_id")).alias("value"))


@query("select symbol, cast(date as varchar) as date, round(close / nullif(lag(close, 5) over w, 0) - 1, 8) as pct_5, round(close - lag(close, 21) over w, 8) as diff_21 from daily window w as (partition by symbol order by date)", ("daily",))
def pct_change(spark, sf_dir):
    w = X.by("symbol")
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(X.pct_change("close", w, 5)).alias("pct_5"), r(X.change("close", w, 21)).alias("diff_21"))


@query(
    """with recursive x as (select symbol, daily_return as v, row_number() over (partition by symbol order by date) as i, date from daily where daily_return is not null),
 e as (select symbol, i, date, v as ewma from x where i = 1 union all select x.symbol, x.i, x.date, 0.94 * e.ewma + 0.06 * x.v from e join x on x.symbol = e.symbol and x.i = e.i + 1) select symbol, cast(date as varchar) as date, round(ewma, 8) as ewma from e""",
    ("daily",),
)
def ewma(spark, sf_dir):
    rows = daily(spark, sf_dir).where("daily_return is not null").select("symbol", "date", "daily_return")
    return series.ewma(rows, "symbol", "daily_return").select("symbol", d().alias("date"), r("ewma").alias("ewma"))


@query(
    """select symbol, cast(date as varchar) as date, round(z, 6) as z from (select *, row_number() over (partition by symbol order by z desc, date) as rn from (select d.symbol, d.date, (d.daily_return - s.m) / s.sd as z from daily d
 join (select symbol, avg(daily_return) as m, stddev_samp(daily_return) as sd from daily group by symbol having count(daily_return) >= 30) s on s.symbol = d.symbol where s.sd > 0) x where z > 2) y where rn <= 8""",
    ("daily",),
)
def zscore_spikes(spark, sf_dir):
    x = daily(spark, sf_dir)
    s = x.groupBy("symbol").agg(F.avg("daily_return").alias("m"), F.stddev_samp("daily_return").alias("sd"), F.count("daily_return").alias("n")).where("n >= 30 and sd > 0")
    z = x.join(s, "symbol").select("symbol", "date", ((F.col("daily_return") - F.col("m")) / F.col("sd")).alias("z")).where("z > 2")
    return series.latest_per_key(z, ["symbol"], [F.col("z").desc(), F.col("date")], 8).select("symbol", d().alias("date"), r("z", 6).alias("z"))


@query(f"select symbol, cast(date as varchar) as date, previous, regime from (select *, lag(regime) over (partition by symbol order by date) as previous from ({QCUT}) q) x where previous is not null and previous <> regime", ("daily",))
def regime_boundaries(spark, sf_dir):
    return series.boundaries(series.quantile_labels(daily(spark, sf_dir)), ["symbol"], "regime").select("symbol", d().alias("date"), "previous", "regime")


BOUNDS = f"select symbol, date, previous, regime from (select *, lag(regime) over (partition by symbol order by date) as previous from ({QCUT}) q) x where previous is not null and previous <> regime"


@query(
    f"""with recursive b as materialized (select *, row_number() over (partition by symbol order by date) as k from ({BOUNDS}) y),
 kept as (select symbol, date, k from b where k = 1 union all select n.symbol, n.date, n.k from kept t join lateral (select * from b where b.symbol = t.symbol and b.date >= t.date + interval 365 day order by b.date limit 1) n on true)
 select b.symbol, cast(b.date as varchar) as date, previous, regime from b join kept on kept.symbol = b.symbol and kept.k = b.k""",
    ("daily",),
)
def regime_boundaries_thinned(spark, sf_dir):
    """Boundaries at least 365 days apart: each symbol's first one, then always the first that is far enough from the one kept before."""
    found = series.boundaries(series.quantile_labels(daily(spark, sf_dir)), ["symbol"], "regime")
    return series.thinned(found, ["symbol"], 365).select("symbol", d().alias("date"), "previous", "regime")


@query(
    f"""select symbol, regime, cast(min(date) as varchar) as start, cast(max(date) as varchar) as stop, count(*) as n_rows from (select *, sum(new) over (partition by symbol order by date) as run from (select *, case when regime <> lag(regime) over (partition by symbol order by date)
 then 1 else 0 end as new from ({QCUT}) q) x) y group by symbol, run, regime""",
    ("daily",),
)
def regime_runs(spark, sf_dir):
    return series.runs(series.quantile_labels(daily(spark, sf_dir)), ["symbol"], "regime").select("symbol", "regime", d("start").alias("start"), d("stop").alias("stop"), "n_rows")


RATIO = "select date, ratio / first_value(ratio) over (order by date) as rebased from (select a.date, a.close / nullif(b.close, 0) as ratio from prices a join prices b on a.date = b.date where a.symbol = 'Brand#2' and b.symbol = 'Brand#1') x"


def ratio_series(spark, sf_dir):
    p = bars.prices(spark, sf_dir).where("symbol in ('Brand#1', 'Brand#2')")
    rows = series.pairs(p, "symbol", "date", "close").select("a", "b", "date", F.try_divide("y", "x").alias("ratio"))
    return rows.withColumn("rebased", F.col("ratio") / F.first("ratio").over(X.upto(X.by(["a", "b"]))))


@query(f"select cast(date as varchar) as date, round(rebased, 8) as rebased from ({RATIO}) z", ("prices",))
def relative_strength_ratio(spark, sf_dir):
    return ratio_series(spark, sf_dir).select(d().alias("date"), r("rebased").alias("rebased"))


@query(f"select * from (select cast(date as varchar) as date, round(case when count(rebased) over w >= 126 then (rebased - avg(rebased) over w) / nullif(stddev_samp(rebased) over w, 0) end, 6) as z from ({RATIO}) q window w as (order by date rows between 125 preceding and current row)) x where z is not null", ("prices",))
def ratio_rolling_zscore(spark, sf_dir):
    rows = ratio_series(spark, sf_dir)
    return rows.select(d().alias("date"), r(X.zscore("rebased", X.last_n(X.by(["a", "b"]), 126), 126), 6).alias("z")).where("z is not null")


@query("select symbol, round(avg(close), 8) as sma, count(*) as n from (select *, row_number() over (partition by symbol order by date desc) as rn from prices) p where rn <= 30 group by symbol", ("prices",))
def sparkline_points(spark, sf_dir):
    return series.latest_per_key(bars.prices(spark, sf_dir), ["symbol"], [F.col("date").desc()], 30).groupBy("symbol").agg(r(F.avg("close")).alias("sma"), F.count(F.lit(1)).alias("n"))


@query(
    """select symbol, round(r5, 8) as r5, round(r20, 8) as r20, round(gap, 8) as gap from (select symbol, close / nullif(lag(close, 5) over w, 0) - 1 as r5, close / nullif(lag(close, 20) over w, 0) - 1 as r20, close / ma_50 - 1 as gap, row_number() over (partition by symbol order by date desc) as rn
 from daily window w as (partition by symbol order by date)) x where rn = 1""",
    ("daily",),
)
def return_n_periods(spark, sf_dir):
    w = X.by("symbol")
    rows = daily(spark, sf_dir).withColumns({"r5": X.pct_change("close", w, 5), "r20": X.pct_change("close", w, 20), "gap": F.col("close") / F.col("ma_50") - 1})
    return series.latest_per_key(rows, ["symbol"], [F.col("date").desc()]).select("symbol", *(r(c).alias(c) for c in ("r5", "r20", "gap")))


@query(
    """select l.series_id, round(l.value / nullif(arg_max(m.value, m.date), 0) - 1, 8) as yoy from (select series_id, max(date) as date, arg_max(value, date) as value, count(*) as n from macro group by 1) l
 join macro m on m.series_id = l.series_id and m.date <= l.date - interval 12 month where l.n >= 13 group by l.series_id, l.value""",
    ("macro",),
)
def yoy_change(spark, sf_dir):
    m = bars.macro(spark, sf_dir)
    last = m.groupBy("series_id").agg(F.max("date").alias("latest"), F.max_by("value", "date").alias("now"), F.count(F.lit(1)).alias("n")).where("n >= 13")
    prior = m.join(last, "series_id").where(F.col("date") <= F.add_months("latest", -12)).groupBy("series_id", "now").agg(F.max_by("value", "date").alias("was"))
    return prior.select("series_id", r(F.try_divide("now", "was") - 1).alias("yoy"))


@query("select symbol, cast(date as varchar) as date from (select *, row_number() over (partition by symbol order by date) - 1 as i from prices) p where i % 21 = 0", ("prices",))
def strided_sample(spark, sf_dir):
    rows = bars.prices(spark, sf_dir).withColumn("i", F.row_number().over(X.by("symbol")) - 1)
    return rows.where("i % 21 = 0").select("symbol", d().alias("date"))


@query(
    """select strategy, cast(date as varchar) as date, round(x, 8) as daily_return from (select strategy, date, x, max(case when started then 1 else 0 end) over (partition by window_id order by date) as on_ from (select *, bool_or(x <> 0) over (partition by window_id, date) as started
 from (select *, case when date < date '1996-01-01' then 0 else daily_return end as x from strat) a) b) c where on_ = 1""",
    ("strat",),
)
def warmup_trim(spark, sf_dir):
    s = strategies(spark, sf_dir).withColumn("x", F.when(F.col("date") < "1996-01-01", 0.0).otherwise(F.col("daily_return")))
    start = s.where("x <> 0").groupBy("window_id").agg(F.min("date").alias("start"))
    return s.join(start, "window_id").where("date >= start").select("strategy", d().alias("date"), r("x").alias("daily_return"))


# --- sorts, sets, reshaping ----------------------------------------------------------------------


@query("select event_id, event_type from events order by ts desc, event_id desc limit 12")
def latest_n_runs(spark, sf_dir):
    return bars.scan(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(12).select("event_id", "event_type")


@query("select symbol, cast(date as varchar) as date, round(close, 8) as close from prices order by symbol, date", ("prices",))
def order_by(spark, sf_dir):
    return bars.prices(spark, sf_dir).orderBy("symbol", "date").select("symbol", d().alias("date"), r("close").alias("close"))


@query(
    f"""select regime, arg_max(strategy, ann) as best, arg_min(strategy, ann) as worst from (select s.strategy, g.regime, avg(s.daily_return) as ann from strat s join ({REGIMES}) g on g.date = s.date group by 1, 2) x group by regime""",
    ("strat",),
)
def rank_best_worst(spark, sf_dir):
    p = P.regime_performance(strategies(spark, sf_dir), regimes(spark, sf_dir))
    return p.groupBy("regime").agg(F.max_by("strategy", "ann_return").alias("best"), F.min_by("strategy", "ann_return").alias("worst"))



@query("select symbol, 'a' as part from prices where symbol < 'Brand#2' union all select symbol, null from prices where symbol >= 'Brand#2'", ("prices",))
def union_by_name(spark, sf_dir):
    p = bars.prices(spark, sf_dir).select("symbol")
    return p.where("symbol < 'Brand#2'").withColumn("part", F.lit("a")).unionByName(p.where("symbol >= 'Brand#2'"), allowMissingColumns=True)


@query("select cast(date as varchar) as date, max(case when series_id = 'DGS10' then value end) as dgs10, max(case when series_id = 'DGS2' then value end) as dgs2, max(case when series_id = 'VIXCLS' then value end) as vixcls from macro group by date", ("macro",))
def pivot_long_to_wide(spark, sf_dir):
    wide = bars.macro(spark, sf_dir).groupBy("date").pivot("series_id", ["DGS10", "DGS2", "VIXCLS"]).agg(F.first("value"))
    return wide.select(d().alias("date"), F.col("DGS10").alias("dgs10"), F.col("DGS2").alias("dgs2"), F.col("VIXCLS").alias("vixcls"))


@query("select user_id, round(arg_max(value, event_id) filter (where event_type = 'click'), 8) as click, round(arg_max(value, event_id) filter (where event_type = 'view'), 8) as view from events group by user_id")
def eav_pivot(spark, sf_dir):
    return bars.scan(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(r(F.max_by("value", "event_id")))


@query(
    """select * from (select symbol, 'n' as metric, cast(count(*) as double) as value from daily group by symbol union all select symbol, 'vol', round(stddev_samp(daily_return), 8) from daily group by symbol union all select symbol, 'mean', round(avg(daily_return), 8) from daily group by symbol) x where value is not null""",
    ("daily",),
)
def unpivot_metrics(spark, sf_dir):
    wide = daily(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).cast("double").alias("n"), r(F.stddev_samp("daily_return")).alias("vol"), r(F.avg("daily_return")).alias("mean"))
    return wide.unpivot("symbol", ["n", "vol", "mean"], "metric", "value").where("value is not null")


@query("select distinct symbol from prices where volume = 0 except select symbol from prices where asset_class = 'fx'", ("prices",))
def distinct_except(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    return p.where("volume = 0").select("symbol").distinct().join(p.where("asset_class = 'fx'").select("symbol"), "symbol", "left_anti")


@query("select m.model, h.horizon, s.symbol from (values ('linear'), ('boosted')) m(model), (values (1), (5), (20)) h(horizon), (select distinct symbol from prices) s", ("prices",))
def combinatorial_grid(spark, sf_dir):
    grid = [(m, h) for m in ("linear", "boosted") for h in (1, 5, 20)]
    symbols = bars.prices(spark, sf_dir).select("symbol").distinct()
    configs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon")) for m, h in grid)))
    return symbols.select("symbol", configs.alias("c")).select("c.model", "c.horizon", "symbol")
