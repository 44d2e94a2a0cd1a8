"""Sweeps, boosted trees, gates, snapshots and the marts that pass rows through."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as X
from ..operators import contracts as C
from ..operators import evaluation as E
from ..operators import features as FT
from ..operators import performance as PF
from ..operators import portfolio as P
from ..operators import series
from ..operators import volatility as V
from ..sources import bars, landing
from ..streaming.incremental import scratch, shared_folder
from .analytics import DRAW
from .portfolios import BT, NUM, REPS, SEED, SH, N, boot_dates, boot_sql, rows_of, tested, trailing, with_boot
from .registry import d, daily, query, r, strategies


def folder(spark) -> str:
    """A new folder below the shared one."""
    return scratch(shared_folder(spark), "tables")


@query("select 'macro' as \"table\", count(*) as rows from macro union all select 'prices', count(*) from prices", ("prices", "macro"))
def export_snapshot(spark, sf_dir):
    """A snapshot of one table is followed by one of both; the rows are the second one's manifest, read back."""
    path, tables = folder(spark), {"macro": bars.macro(spark, sf_dir), "prices": bars.prices(spark, sf_dir)}
    landing.export_snapshot({"macro": tables["macro"]}, path)
    landing.export_snapshot(tables, path)
    return landing.snapshot_table(spark, path, "_manifest")


@query("select symbol, cast(date as varchar) as date, round(close, 8) as close, cast(null as varchar) as loaded_by from prices union all select 'audit', null, cast(0 as double), 'run_id,status,rows'", ("prices",))
def ensure_schema(spark, sf_dir):
    """A stored table without ``loaded_by`` gets that column, a table that is absent is made: the rows of the first, and how many rows and which columns the second has."""
    path, run = folder(spark), uuid.uuid4().hex
    prices, audit = f"tidewheel_prices_{run}", f"tidewheel_audit_{run}"
    stored = bars.prices(spark, sf_dir).select("symbol", "date", "close")
    stored.write.option("path", f"{path}/{prices}").format("parquet").saveAsTable(prices)
    wanted = {prices: T.StructType([*stored.schema, T.StructField("loaded_by", T.StringType())]), audit: T.StructType.fromDDL("run_id string, status string, rows long")}
    landing.ensure_tables(spark, wanted, path)
    landing.ensure_tables(spark, wanted, path)
    made = spark.table(audit)
    n = made.agg(F.count(F.lit(1)).cast("double").alias("close")).select(F.lit("audit").alias("symbol"), F.lit(None).cast("string").alias("date"), "close", F.lit(",".join(made.columns)).alias("loaded_by"))
    got = spark.table(prices).select("symbol", d().alias("date"), r("close").alias("close"), "loaded_by").unionByName(n)
    for name in wanted:
        spark.sql(f"drop table {name}")  # the files stay, and the frame reads them
    return got


@query("select symbol, count(*) as n from prices where asset_class = 'fx' group by symbol", ("prices",))
def replace_table(spark, sf_dir):
    """A table is written twice; the second write replaces the first."""
    path, p = folder(spark), bars.prices(spark, sf_dir)
    p.write.mode("overwrite").parquet(path)
    p.where("asset_class = 'fx'").write.mode("overwrite").parquet(path)
    return spark.read.schema(p.schema).parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("select 'prices' as \"table\", count(*) as before, cast(0 as bigint) as after, 'symbol,asset_class,date,open,high,low,close,volume,source' as columns from prices union all select 'macro', count(*), 0, 'series_id,date,value,source' from macro", ("prices", "macro"))
def reset_tables(spark, sf_dir):
    """A family of tables is emptied and keeps its schema: rows before and after, and the columns that are left."""
    out = None
    for name, df in (("prices", bars.prices(spark, sf_dir)), ("macro", bars.macro(spark, sf_dir))):
        path = f"{folder(spark)}/{name}"
        df.write.parquet(path)
        before = spark.read.schema(df.schema).parquet(path).count()
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
        left = spark.read.parquet(path)
        row = left.agg(F.count(F.lit(1)).alias("after")).select(F.lit(name).alias("table"), F.lit(before).cast("long").alias("before"), "after", F.lit(",".join(left.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    f"""select window_id, strategy, cast(date as varchar) as date, round(daily_return, 8) as daily_return, round(cumulative_return, 6) as cumulative_return, round(drawdown, 6) as drawdown,
 round(avg(daily_return) over w / nullif(stddev_samp(daily_return) over w, 0) * sqrt(252.0), 6) as rolling_sharpe from ({DRAW}) x window w as (partition by strategy order by date rows between 251 preceding and current row)""",
    ("strat",),
)
def fct_portfolio_returns(spark, sf_dir):
    w = X.last_n(X.by("strategy"), 252)
    s = F.avg("daily_return").over(w) / F.nullif(F.stddev_samp("daily_return").over(w), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    rows = PF.drawdowns(strategies(spark, sf_dir), ["strategy"])
    return rows.select("window_id", "strategy", d().alias("date"), r("daily_return").alias("daily_return"), r("cumulative_return", 6).alias("cumulative_return"), r("drawdown", 6).alias("drawdown"), r(s, 6).alias("rolling_sharpe"))


@query("select symbol, asset_class, cast(date as varchar) as date, round(close, 8) as close, volume, source, round(daily_return, 8) as daily_return, round(vol_20d, 8) as vol_20d, round(ma_50 + 1e-9, 6) as ma_50 from daily", ("daily",))
def fct_asset_daily(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", "asset_class", d().alias("date"), r("close").alias("close"), "volume", "source", r("daily_return").alias("daily_return"), r("vol_20d").alias("vol_20d"), r(F.col("ma_50") + 1e-9, 6).alias("ma_50"))  # off the ties


BR = "select rep, strategy, exp(sum(ln(1 + daily_return)) * 252 / count(*)) - 1 as g from boot group by 1, 2"


@query(
    with_boot(f"""select x.strategy as a, y.strategy as b, round(quantile_cont(x.g - y.g, 0.05), 5) as lo, round(quantile_cont(x.g - y.g, 0.95), 5) as hi, quantile_cont(x.g - y.g, 0.05) > 0 or quantile_cont(x.g - y.g, 0.95) < 0 as distinguishable,
 round(greatest(1.0 / {REPS}, least(1.0, 2 * least(avg(case when x.g - y.g <= 0 then 1.0 else 0.0 end), avg(case when x.g - y.g >= 0 then 1.0 else 0.0 end)))), 8) as p from ({BR}) x join ({BR}) y on x.rep = y.rep and x.strategy < y.strategy group by 1, 2"""),
    ("strat",),
)
def bootstrap_return_pairs(spark, sf_dir):
    g = P.resampled(boot_dates(spark, sf_dir), REPS, SEED).groupBy("rep", "strategy").agg(PF.annual_return("daily_return").alias("g"))
    diff = series.pairs(g, "strategy", "rep", "g").withColumn("d", F.col("x") - F.col("y"))
    got = diff.groupBy("a", "b").agg(F.percentile("d", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.greatest(F.lit(1.0 / REPS), P.p_value(F.col("d"))).alias("p"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return got.select("a", "b", r(lo, 5).alias("lo"), r(hi, 5).alias("hi"), ((lo > 0) | (hi < 0)).alias("distinguishable"), r("p").alias("p"))


#: The universe of each strategy of the second window: one symbol is left out.
LEFT_OUT = ("Brand#3", "Brand#8", "Brand#12")
EX = f"""select strategy, date, avg(daily_return) as ex from (select case when symbol in ('Brand#1', 'Brand#2') then 'equal_weight' when symbol = 'Brand#7' then 'tilt' else 'regime' end as strategy, date, daily_return from daily
 where symbol in ('Brand#1', 'Brand#2', 'Brand#7', 'Brand#11') and daily_return is not null and extract(dow from date) between 1 and 5) u group by 1, 2"""


@query(
    f"""with ex as materialized ({EX}), pairs as materialized (select s.strategy, s.date, s.daily_return as inc, e.ex from strat s join ex e on e.strategy = s.strategy and e.date = s.date),
 common as materialized (select date, row_number() over (order by date) - 1 as i from (select date from pairs group by date having count(*) = 3) z), size as materialized (select cast(count(*) as bigint) as n from common),
 draws as materialized ({boot_sql(N)}), s as (select b.rep, p.strategy, coalesce(avg(p.inc) / nullif(stddev_samp(p.inc), 0), 0) * sqrt(252.0) - coalesce(avg(p.ex) / nullif(stddev_samp(p.ex), 0), 0) * sqrt(252.0) as d from draws b join common c on c.i = b.i join pairs p on p.date = c.date group by 1, 2)
 select strategy, round(quantile_cont(d, 0.05), 5) as diff_lo, round(quantile_cont(d, 0.95), 5) as diff_hi, count(*) as n_boot from s group by strategy""",
    ("strat",),
)
def paired_window_effect(spark, sf_dir):
    """Sharpe ratio of each strategy with one symbol included less that without it, on common dates and the same draws."""
    inc = strategies(spark, sf_dir).select("strategy", "date", "daily_return")
    ex = strategies(spark, sf_dir, LEFT_OUT).select("strategy", "date", F.col("daily_return").alias("ex"))
    both = inc.join(ex, ["strategy", "date"])
    full = both.groupBy("date").agg(F.count(F.lit(1)).alias("k")).where("k = 3").select("date")
    s = P.resampled(both.join(full, "date", "left_semi"), REPS, SEED)
    diff = s.groupBy("rep", "strategy").agg((PF.sharpe("daily_return") - PF.sharpe("ex")).alias("d"))
    return P.interval(diff, ["strategy"], "d").select("strategy", r("lo", 5).alias("diff_lo"), r("hi", 5).alias("diff_hi"), "n_boot")


def vol_rows(spark, sf_dir):
    """The volatility features of all symbols with their regime, a third of each symbol's days."""
    x = daily(spark, sf_dir)
    regimes = series.quantile_labels(x).select("symbol", "date", "regime")
    return FT.feature_set(x, "vol").join(regimes, ["symbol", "date"], "left").withColumn("regime", F.coalesce("regime", F.lit("Medium")))


@query()
def vol_forecast_value(spark, sf_dir):
    """The forecast after each symbol's last day, by year."""
    return V.next_forecast(vol_rows(spark, sf_dir)).select("symbol", d().alias("as_of"), r("forecast").alias("forecast"), r("annualised", 6).alias("annualised"))


@query(
    """select symbol, round(greatest(-bound, least(bound, 0.5 * pred + 0.5 * m)), 8) as calibrated from (select symbol, arg_max(daily_return, date) as pred, avg(daily_return) as m, greatest(0.05, 1.5 * coalesce(stddev_samp(daily_return) filter (where rn <= 60), 0.15)) as bound
 from (select *, row_number() over (partition by symbol order by date desc) as rn from daily where daily_return is not null) x group by symbol) y""",
    ("daily",),
)
def calibration_bounds(spark, sf_dir):
    """The calibration of a forecast, shown on the last return as the forecast."""
    rows = daily(spark, sf_dir).where("daily_return is not null").withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("date").desc())))
    got = rows.groupBy("symbol").agg(F.max_by("daily_return", "date").alias("pred"), F.avg("daily_return").alias("m"), F.stddev_samp(F.when(F.col("rn") <= 60, F.col("daily_return"))).alias("sd"))
    bound = F.greatest(F.lit(0.05), 1.5 * F.coalesce("sd", F.lit(0.15)))
    return got.select("symbol", r(F.greatest(-bound, F.least(bound, 0.5 * F.col("pred") + 0.5 * F.col("m")))).alias("calibrated"))


@query(f"select symbol, cast(k as integer) as fold, n - (5 - k) * (n // 6) as train_to, n - (4 - k) * (n // 6) as test_to from (select symbol, count(*) as n from ({NUM}) z group by 1) a, range(0, 5) g(k)", ("daily",))
def timeseries_cv_split(spark, sf_dir):
    """Five expanding folds; a test part is a sixth of the rows."""
    n = rows_of(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.floor(F.count(F.lit(1)) / 6).alias("t"))
    f = n.select("symbol", "n", "t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    return f.select("symbol", "fold", (F.col("n") - (5 - F.col("fold")) * F.col("t")).alias("train_to"), (F.col("n") - (4 - F.col("fold")) * F.col("t")).alias("test_to"))


@query("with s as (select *, row_number() over (partition by strategy order by date) as k from strat) select strategy, count(*) as n from s where k <= case strategy when 'tilt' then 10 when 'regime' then 3 else 0 end group by strategy", ("strat",))
def check_excludes_warmup(spark, sf_dir):
    """Days of a strategy before anything was invested, which a published table must not have. Two of three strategies are
    given some, with a return of 0."""
    cash = F.when(F.col("strategy") == "tilt", 10).when(F.col("strategy") == "regime", 3).otherwise(0)
    s = strategies(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("strategy").orderBy("date")))
    s = s.withColumn("daily_return", F.when(F.col("k") <= cash, 0.0).otherwise(F.col("daily_return")))
    return C.before_start(s, ["strategy"], "daily_return").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


#: A return forecast that SQL can say, too: the mean of the five returns before; a fold is a year.
RF = "select *, extract(year from date) as fold from (select symbol, date, daily_return as y, case when count(daily_return) over w = 5 then avg(daily_return) over w end as pred from daily window w as (partition by symbol order by date rows between 5 preceding and 1 preceding)) x where y is not null and pred is not null"
RM = f"""select a.*, f.n_folds, f.folds_passed from (select symbol, count(*) as n_obs, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0) as r2, avg(case when sign(pred) = sign(y) then 1.0 else 0.0 end) as direction_accuracy, avg(sign(pred) * y) * 252 as annualised_alpha,
 avg(sign(pred) * y - 0.0005 * t) / nullif(stddev_samp(sign(pred) * y - 0.0005 * t), 0) * sqrt(252.0) as turnover_adjusted_sharpe from (select *, case when sign(pred) <> lag(sign(pred), 1, 0) over (partition by symbol order by date) then 1 else 0 end as t from ({RF}) r) z group by symbol) a
 join (select symbol, count(*) as n_folds, sum(case when r2 > 0 then 1 else 0 end) as folds_passed from (select symbol, fold, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0) as r2 from ({RF}) r group by 1, 2) g group by symbol) f on f.symbol = a.symbol"""


@query(
    f"""select symbol, reasons = '' as cleared, reasons from (select symbol, concat_ws(',', case when coalesce(r2 > 0, false) then null else 'r2' end, case when coalesce(direction_accuracy > 0.5, false) then null else 'direction_accuracy' end,
 case when coalesce(n_folds >= 1 and folds_passed >= ceil(0.6 * n_folds), false) then null else 'folds_passed' end, case when coalesce(n_obs >= 252, false) then null else 'n_obs' end, case when coalesce(abs(annualised_alpha) > 0.0005, false) then null else 'annualised_alpha' end,
 case when coalesce(turnover_adjusted_sharpe > 0, false) then null else 'turnover_adjusted_sharpe' end) as reasons from ({RM}) m) x""",
    ("daily",),
)
def return_verdict(spark, sf_dir):
    """All rules of the return gate on a forecast by the mean of the five returns before."""
    w = X.by("symbol")
    f = X.before_n(w, 5)
    rows = daily(spark, sf_dir).select("symbol", "date", F.col("daily_return").alias("y"), X.rolling(F.avg, "daily_return", f, 5).alias("pred"), F.year("date").alias("fold")).where("y is not null and pred is not null")
    r2 = 1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("pred"), F.lit(2.0))), F.var_pop("y") * F.count("y"))
    turned = (F.signum("pred") != F.lag(F.signum("pred"), 1, 0.0).over(w)).cast("int")
    own = F.signum("pred") * F.col("y")
    net = own - 0.0005 * F.col("t")
    whole = rows.withColumn("t", turned).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_obs"), r2.alias("r2"), F.avg(F.when(F.signum("pred") == F.signum("y"), 1.0).otherwise(0.0)).alias("direction_accuracy"), (F.avg(own) * 252).alias("annualised_alpha"),
        (F.try_divide(F.avg(net), F.stddev_samp(net)) * F.sqrt(F.lit(252.0))).alias("turnover_adjusted_sharpe"),
    )
    folds = rows.groupBy("symbol", "fold").agg(r2.alias("r2")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_folds"), F.sum(F.when(F.col("r2") > 0, 1).otherwise(0)).alias("folds_passed"))
    got = E.return_gate(whole.join(folds, "symbol"))
    return got.select("symbol", "cleared", F.array_join("reasons", ",").alias("reasons"))


METRICS = ("oos_r2", "qlike", "baseline_qlike", "qlike_skill_ratio", "holdout_oos_r2", "holdout_qlike", "holdout_qlike_skill_ratio")


def metrics_of(out):
    return V.scores(out).select("symbol", F.col("n_obs").cast("long").alias("n_obs"), "n_folds", "folds_passed", "holdout_n_obs", *(r(m, 6).alias(m) for m in METRICS))


@query()
def vol_backtest(spark, sf_dir):
    """Five expanding folds and a locked holdout of every symbol: the log-space model against the EWMA."""
    return metrics_of(V.forecasts(V.sliced(vol_rows(spark, sf_dir))))


@query()
def har_regime(spark, sf_dir):
    """The same with a model for each regime; regimes with few rows take the model of all."""
    return metrics_of(V.forecasts(V.sliced(vol_rows(spark, sf_dir)), regime="regime"))


@query()
def ridge_volatility(spark, sf_dir):
    return metrics_of(V.forecasts(V.sliced(vol_rows(spark, sf_dir)), ridge=1.0))


@query()
def lasso_volatility(spark, sf_dir):
    return metrics_of(V.forecasts(V.sliced(vol_rows(spark, sf_dir)), lasso=0.01))


@query()
def vol_gate(spark, sf_dir):
    """The skill gate on the backtest's own metrics."""
    got = E.skill_gate(V.scores(V.forecasts(V.sliced(vol_rows(spark, sf_dir)))))
    return got.select("symbol", "cleared", F.array_join("reasons", ",").alias("reasons"))


@query()
def shrink_covariance(spark, sf_dir):
    return P.shrunk_covariances(trailing(spark, sf_dir)).select(d("rebalance").alias("rebalance"), "a", "b", r("cov").alias("cov"))


@query(
    """select symbol, cast(date as varchar) as date from (select *, coalesce(abs(close - open - diff) <= 0.0004, false) as same, coalesce((low - 100 > 0 or high - 100 < 0) = (close > 100), false) as flagged from (select *, round(close - open, 3) as diff from prices) q) p where not same or not flagged""",
    ("prices",),
)
def check_effect(spark, sf_dir):
    """The published difference, rounded, must be that of its parts, and the flag say whether the interval leaves out zero."""
    p = bars.prices(spark, sf_dir).withColumns({"diff": F.round(F.col("close") - F.col("open"), 3), "lo": F.col("low") - 100, "hi": F.col("high") - 100, "flag": F.col("close") > 100})
    return C.pair_consistent(p, "close", "open", "diff", "lo", "hi", "flag", 0.0004).select("symbol", d().alias("date"))


def returns_ahead(spark, sf_dir, horizon: int):
    w = X.by("symbol")
    y = X.rolling(F.sum, "daily_return", w.rowsBetween(1, horizon), horizon)
    return rows_of(spark, sf_dir).withColumns({"y": y, "l1": F.col("daily_return"), "l2": F.lag("daily_return").over(w), "m20": F.avg("daily_return").over(X.last_n(w, 20))})


def forecast(spark, sf_dir, horizon: int, train: int, ridge: float = 0.01, lasso: float = 0.0):
    names, rows = ["l1", "l2", "m20"], returns_ahead(spark, sf_dir, horizon)
    f = E.folds(rows, train, 100, horizon)
    return E.predicted(rows, f, E.least_squares(rows, f, names, "y", ridge=ridge, lasso=lasso), names).where("y is not null and pred is not null")


@query()
def lasso_forecast(spark, sf_dir):
    p = forecast(spark, sf_dir, 1, 250, 0.0, 1e-5)
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.corr("pred", "y"), 4).alias("ic"))


SUBSETS = {"lags": ["l1", "l2"], "lags_mean": ["l1", "l2", "m20"]}


def return_rows(spark, sf_dir):
    """Returns over the next 1, 5 and 20 rows, with what is known before."""
    w = X.by("symbol")
    ahead = {f"y{h}": X.rolling(F.sum, "daily_return", w.rowsBetween(1, h), h) for h in (1, 5, 20)}
    return rows_of(spark, sf_dir).withColumns(ahead | {"l1": F.col("daily_return"), "l2": F.lag("daily_return").over(w), "m20": F.avg("daily_return").over(X.last_n(w, 20))})


def return_grid(spark, sf_dir):
    """Three horizons, three training lengths, two sets of features and four penalties: 72 configurations in one job."""
    return E.grid_forecasts(return_rows(spark, sf_dir), {1: "y1", 5: "y5", 20: "y20"}, SUBSETS, [250, 500, 1260], [0.0, 0.01, 0.1, 1.0])


@query()
def panel_run(spark, sf_dir):
    """Forecasts for every symbol and horizon as one table: mu is the forecast over the horizon, also for the last rows, whose returns aren't known."""
    out = E.grid_forecasts(return_rows(spark, sf_dir), {1: "y1", 5: "y5", 20: "y20"}, {"last_mean": ["l1", "m20"]}, [500], [0.01], test=250, unknown=True)
    return out.where("pred is not null").select("symbol", d().alias("date"), "horizon", r(F.col("pred") / F.col("horizon")).alias("mu"))


@query()
def return_sweep(spark, sf_dir):
    keys = ["horizon", "train", "features", "ridge", "symbol"]
    got = E.forecast_scores(return_grid(spark, sf_dir), keys)
    return got.select(*keys, "n", r("ic", 5).alias("ic"), r("accuracy", 6).alias("accuracy"), r("r2", 5).alias("r2"), "n_folds", "folds_passed")


@query()
def return_ensemble(spark, sf_dir):
    """The horizons of one configuration combined by date: mean, median, weighted by skill."""
    out = E.grid_forecasts(return_rows(spark, sf_dir), {1: "y1", 5: "y5", 20: "y20"}, {"lags_mean": SUBSETS["lags_mean"]}, [250], [0.01])
    got = E.ensembles(out, ["symbol"])
    return got.select("symbol", d().alias("date"), *(r(x).alias(x) for x in ("mean", "median", "weighted")), "n_horizons")


# --- marts passed through, with their contracts ------------------------------------------------------

BLOCK = 21
SHARPE = "coalesce(avg(daily_return) / nullif(stddev_samp(daily_return), 0), 0) * sqrt(252.0)"


@query(
    with_boot(f"""select 'long' as window_id, o.strategy, round(o.sharpe, 5) as sharpe, round(b.lo, 5) as sharpe_lo, round(b.hi, 5) as sharpe_hi, o.n_obs, b.n_boot, 90 as ci_pct, {BLOCK} as block_days
 from (select strategy, {SHARPE} as sharpe, count(*) as n_obs from returns group by 1) o join (select strategy, quantile_cont(s, 0.05) as lo, quantile_cont(s, 0.95) as hi, count(*) as n_boot from ({SH}) x group by 1) b on b.strategy = o.strategy"""),
    ("strat",),
)
def fct_portfolio_strategy_stats(spark, sf_dir):
    """Sharpe ratio of each strategy on the common dates with its bootstrap interval; one row for each window and strategy, lo <= hi."""
    rows = boot_dates(spark, sf_dir)
    own = rows.groupBy("strategy").agg(PF.sharpe("daily_return").alias("sharpe"), F.count(F.lit(1)).alias("n_obs"))
    drawn = P.resampled(rows, REPS, SEED).groupBy("rep", "strategy").agg(PF.sharpe("daily_return").alias("s"))
    got = own.join(P.interval(drawn, ["strategy"], "s"), "strategy")
    return got.select(F.lit("long").alias("window_id"), "strategy", r("sharpe", 5).alias("sharpe"), r("lo", 5).alias("sharpe_lo"), r("hi", 5).alias("sharpe_hi"), "n_obs", "n_boot", F.lit(90).alias("ci_pct"), F.lit(BLOCK).alias("block_days"))


@query(
    with_boot(f"""select 'long' as window_id, x.strategy as strategy_a, y.strategy as strategy_b, round(max(p.sharpe), 5) as sharpe_a, round(max(q.sharpe), 5) as sharpe_b, round(max(p.sharpe) - max(q.sharpe), 5) as sharpe_diff, round(quantile_cont(x.s - y.s, 0.05), 5) as diff_lo, round(quantile_cont(x.s - y.s, 0.95), 5) as diff_hi,
 quantile_cont(x.s - y.s, 0.05) > 0 or quantile_cont(x.s - y.s, 0.95) < 0 as distinguishable from ({SH}) x join ({SH}) y on x.rep = y.rep and x.strategy < y.strategy
 join (select strategy, {SHARPE} as sharpe from returns group by 1) p on p.strategy = x.strategy join (select strategy, {SHARPE} as sharpe from returns group by 1) q on q.strategy = y.strategy group by x.strategy, y.strategy"""),
    ("strat",),
)
def fct_portfolio_strategy_pairs(spark, sf_dir):
    """Differences of Sharpe ratios with intervals on the same draws; distinguishable where the interval leaves out zero."""
    rows = boot_dates(spark, sf_dir)
    own = rows.groupBy("strategy").agg(PF.sharpe("daily_return").alias("sharpe"))
    drawn = P.resampled(rows, REPS, SEED).groupBy("rep", "strategy").agg(PF.sharpe("daily_return").alias("s"))
    diff = series.pairs(drawn, "strategy", "rep", "s").withColumn("d", F.col("x") - F.col("y"))
    got = P.interval(diff, ["a", "b"], "d").join(own.select(F.col("strategy").alias("a"), F.col("sharpe").alias("sa")), "a").join(own.select(F.col("strategy").alias("b"), F.col("sharpe").alias("sb")), "b")
    return got.select(
        F.lit("long").alias("window_id"), F.col("a").alias("strategy_a"), F.col("b").alias("strategy_b"), r("sa", 5).alias("sharpe_a"), r("sb", 5).alias("sharpe_b"), r(F.col("sa") - F.col("sb"), 5).alias("sharpe_diff"),
        r("lo", 5).alias("diff_lo"), r("hi", 5).alias("diff_hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("distinguishable"),
    )


@query(
    f"""with bt as materialized ({BT}), ends as (select rebalance, symbol, arg_max(after, date) as e, max(weight) as w from bt group by 1, 2), drift as (select rebalance, symbol, w, e / sum(e) over (partition by rebalance) as dr from ends),
 turn as (select sum(0.5 * abs(w - coalesce(p, 0)) * 0.0005) as cost from (select *, lag(dr) over (partition by symbol order by rebalance) as p from drift) z),
 g as (select date, symbol, held * r as c, sum(held * r) over (partition by date) as total from bt), gross as (select sum(c) as s from g)
 select 'long' as window_id, 'inverse_vol' as strategy, symbol, round(sum(c), 6) as contribution_to_return, round(covar_samp(c, total) / nullif(var_samp(total), 0), 6) as contribution_to_risk, round(any_value(s), 6) as strategy_gross_return from g, gross group by symbol
 union all select 'long', 'inverse_vol', '(costs)', round(-cost, 6), 0.0, round(s, 6) from turn, gross""",
    ("aligned",),
)
def fct_performance_attribution(spark, sf_dir):
    """Attribution of a strategy with its gross return, to which the symbols' contributions sum; costs have a row of their own."""
    got = P.attribution(tested(spark, sf_dir))
    gross = got.where("symbol <> '(costs)'").agg(F.sum("contribution_to_return").alias("gross"))
    out = got.crossJoin(F.broadcast(gross))  # one row
    return out.select(F.lit("long").alias("window_id"), F.lit("inverse_vol").alias("strategy"), "symbol", r("contribution_to_return", 6).alias("contribution_to_return"), r("contribution_to_risk", 6).alias("contribution_to_risk"), r("gross", 6).alias("strategy_gross_return"))


@query(
    f"""with ex as materialized ({EX}), pairs as materialized (select s.strategy, s.date, s.daily_return as inc, e.ex from strat s join ex e on e.strategy = s.strategy and e.date = s.date),
 common as materialized (select date, row_number() over (order by date) - 1 as i from (select date from pairs group by date having count(*) = 3) z), size as materialized (select cast(count(*) as bigint) as n from common),
 draws as materialized ({boot_sql(N)}), s as (select b.rep, p.strategy, coalesce(avg(p.inc) / nullif(stddev_samp(p.inc), 0), 0) * sqrt(252.0) - coalesce(avg(p.ex) / nullif(stddev_samp(p.ex), 0), 0) * sqrt(252.0) as d from draws b join common c on c.i = b.i join pairs p on p.date = c.date group by 1, 2),
 own as (select p.strategy, coalesce(avg(p.inc) / nullif(stddev_samp(p.inc), 0), 0) * sqrt(252.0) as a, coalesce(avg(p.ex) / nullif(stddev_samp(p.ex), 0), 0) * sqrt(252.0) as b, count(*) as n_obs from pairs p join common c on c.date = p.date group by 1)
 select o.strategy, round(any_value(b), 5) as sharpe_ex, round(any_value(a), 5) as sharpe_inc, round(any_value(a - b), 5) as sharpe_diff, round(quantile_cont(d, 0.05), 5) as diff_lo, round(quantile_cont(d, 0.95), 5) as diff_hi,
 quantile_cont(d, 0.05) > 0 or quantile_cont(d, 0.95) < 0 as distinguishable, any_value(n_obs) as n_obs, count(*) as n_boot, 90 as ci_pct from s join own o on o.strategy = s.strategy group by o.strategy""",
    ("strat",),
)
def fct_portfolio_added_effect(spark, sf_dir):
    """Each strategy with and without one symbol on common dates: Sharpe ratios, their difference and its paired interval."""
    inc = strategies(spark, sf_dir).select("strategy", "date", "daily_return")
    ex = strategies(spark, sf_dir, LEFT_OUT).select("strategy", "date", F.col("daily_return").alias("ex"))
    both = inc.join(ex, ["strategy", "date"])
    common = both.join(both.groupBy("date").agg(F.count(F.lit(1)).alias("k")).where("k = 3").select("date"), "date", "left_semi")
    own = common.groupBy("strategy").agg(PF.sharpe("ex").alias("sharpe_ex"), PF.sharpe("daily_return").alias("sharpe_inc"), F.count(F.lit(1)).alias("n_obs"))
    drawn = P.resampled(common, REPS, SEED).groupBy("rep", "strategy").agg((PF.sharpe("daily_return") - PF.sharpe("ex")).alias("d"))
    got = own.join(P.interval(drawn, ["strategy"], "d"), "strategy")
    return got.select(
        "strategy", r("sharpe_ex", 5).alias("sharpe_ex"), r("sharpe_inc", 5).alias("sharpe_inc"), r(F.col("sharpe_inc") - F.col("sharpe_ex"), 5).alias("sharpe_diff"), r("lo", 5).alias("diff_lo"), r("hi", 5).alias("diff_hi"),
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("distinguishable"), "n_obs", "n_boot", F.lit(90).alias("ci_pct"),
    )
