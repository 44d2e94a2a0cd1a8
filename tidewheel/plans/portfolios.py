"""Features, portfolios, evaluation, contracts and incremental loads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from ..operators import contracts as C
from ..operators import evaluation as E
from ..operators import features as FT
from ..operators import performance as PF
from ..operators import portfolio as P
from ..operators import series
from ..sources import bars, landing
from ..streaming import incremental, live
from ..streaming.incremental import scratch, shared_folder
from .registry import calendar, d, daily, query, r, strategies

B = lambda n: f"(partition by symbol order by date rows between {n} preceding and 1 preceding)"
L = lambda n: f"(partition by symbol order by date rows between {n - 1} preceding and current row)"
O = "(partition by symbol order by date)"  # noqa: E741


def roll(agg: str, x: str, frame: str, least: int) -> str:
    return f"case when count({x}) over {frame} >= {least} then {agg}({x}) over {frame} end"


def rounded(df, digits=6):
    keep = [F.col("symbol"), d().alias("date")]
    return df.select(*keep, *(r(x, digits).alias(x) for x in df.columns if x not in ("symbol", "date")))


def feature_sql(parts: dict[str, str], digits: int = 6, rows: str = "daily") -> str:
    return f"select symbol, cast(date as varchar) as date, {', '.join(f'round({v}, {digits}) as {k}' for k, v in parts.items())} from {rows}"


@query("select cast(date as varchar) as date, count(daily_return) as n, round(stddev_samp(daily_return), 8) as dispersion from daily group by date", ("daily",))
def feature_dispersion(spark, sf_dir):
    return FT.dispersion(daily(spark, sf_dir)).select(d().alias("date"), "n", r("dispersion").alias("dispersion"))


@query(
    feature_sql({"raw": "daily_return", "vol_adjusted": f"daily_return / nullif({roll('stddev_samp', 'daily_return', L(20), 10)}, 0)", "excess": f"daily_return - ({roll('median', 'daily_return', L(60), 20)})"}), ("daily",)
)
def build_target(spark, sf_dir):
    return rounded(FT.with_features(daily(spark, sf_dir), {k: FT.target(k) for k in ("raw", "vol_adjusted", "excess")}))


KEPT = " || ".join(f"case when max(sd_{c}) > 0 then '{c},' else '' end" for c in ("daily_return", "volume", "vol_20d"))


@query(
    f"""select symbol, fold, {KEPT} as kept from (select n.symbol, f.fold, {', '.join(f'stddev_pop(n.{c}) as sd_{c}' for c in ('daily_return', 'volume', 'vol_20d'))}
 from (select *, row_number() over (partition by symbol order by date) - 1 as i from daily) n join (select symbol, cast(k as integer) as fold, k * 100 as lo, k * 100 + 250 as hi
 from (select symbol, count(*) as n from daily group by 1) a, range(0, 400) g(k) where n > 255 and k < ceil((n - 255) / 100.0)) f on f.symbol = n.symbol and n.i >= f.lo and n.i < f.hi
 where n.daily_return is not null or n.volume is not null or n.vol_20d is not null group by 1, 2) x group by symbol, fold""",
    ("daily",),
)
def drop_constant_columns(spark, sf_dir):
    """Of every fold's training rows with any value, the columns that vary."""
    rows = E.numbered(daily(spark, sf_dir))
    kept = FT.informative(rows, ["daily_return", "volume", "vol_20d"], E.folds(rows, 250, 100, 5))
    return kept.select("symbol", "fold", F.concat_ws("", F.transform("kept", lambda x: F.concat(x, F.lit(",")))).alias("kept"))


# --- portfolios ----------------------------------------------------------------------------------

#: All symbols on one calendar, from the latest of their first returns on.
FULL = "select symbol, date, daily_return from aligned where date >= (select max(f) from (select min(date) as f from aligned where daily_return is not null group by symbol) z)"
UNI = "select symbol, date, daily_return from daily where daily_return is not null"


def aligned(spark, sf_dir):
    x = daily(spark, sf_dir)
    return P.calendar_align(x, calendar(x))


def universe(spark, sf_dir):
    """All symbols on one calendar, from the latest of their first returns on; written once, as plans read it several times."""
    return landing.written(P.common_start(aligned(spark, sf_dir)), scratch(shared_folder(spark), "universe"))


@query("select symbol, cast(date as varchar) as date, round(daily_return, 8) as daily_return from aligned", ("aligned",))
def calendar_align(spark, sf_dir):
    return aligned(spark, sf_dir).select("symbol", d().alias("date"), r("daily_return").alias("daily_return"))


@query(
    """select symbol, count(*) filter (where x is null and date < f) as leading, count(*) filter (where x is null and date > l) as trailing, count(*) filter (where x is null and date between f and l) as interior, count(*) as n
 from (select *, min(case when x is not null then date end) over (partition by symbol) as f, max(case when x is not null then date end) over (partition by symbol) as l from (select s.symbol, c.date, p.daily_return as x
 from (select distinct symbol from daily) s cross join (select distinct date from daily where symbol = 'Brand#11') c left join daily p on p.symbol = s.symbol and p.date = c.date) y) z group by symbol""",
    ("daily",),
)
def calendar_gap_report(spark, sf_dir):
    """Dates of the reference calendar on which a symbol has no return: before its first one, after its last one, between."""
    x = daily(spark, sf_dir)
    return P.calendar_gaps(x, x.where("symbol = 'Brand#11'").select("date"))


#: The symbol that a window adds, and the date on which windows with a floor begin.
ADDED, FLOOR = "Brand#5", "1996-06-01"
REST = f"select symbol, date, daily_return from daily where symbol <> '{ADDED}'"


@query(
    f"""select 'without' as rule, symbol, cast(date as varchar) as date, round(daily_return, 8) as daily_return from ({REST}) a where date >= (select max(f) from (select min(date) as f from ({REST}) b group by symbol) z)
 union all select 'floor', symbol, cast(date as varchar), round(daily_return, 8) from ({REST}) c where date >= date '{FLOOR}'
 union all select 'with', symbol, cast(date as varchar), round(daily_return, 8) from ({REST}) e where date >= date '{FLOOR}'
 union all select 'with', symbol, cast(date as varchar), round(daily_return, 8) from aligned where symbol = '{ADDED}' and date >= date '{FLOOR}' and daily_return is not null""",
    ("aligned",),
)
def window_panel(spark, sf_dir):
    """The three windows: all symbols but one from the latest common start, from a floor, and with that one aligned to the calendar."""
    x = daily(spark, sf_dir)
    out = None
    for rule in ("without", "floor", "with"):
        one = P.window_panel(x, rule, ADDED, F.lit(FLOOR).cast("date"), calendar(x)).select(F.lit(rule).alias("rule"), "symbol", d().alias("date"), r("daily_return").alias("daily_return"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select cast(date as varchar) as date, round(avg(daily_return), 8) as daily_return, count(*) as n from ({UNI}) u group by date", ("daily",))
def equal_weight_returns(spark, sf_dir):
    x = daily(spark, sf_dir).where("daily_return is not null")
    return P.equal_weight(x).select(d().alias("date"), r("daily_return").alias("daily_return"), "n")


REB = f"select max(date) as date from (select date, row_number() over (order by date) as i from (select distinct date from ({FULL}) f) a) b where i > 60 group by date_trunc('quarter', date)"


def rebalances(spark, sf_dir):
    return P.rebalance_dates(universe(spark, sf_dir), 60, "quarter")


@query(f"select cast(date as varchar) as date from ({REB}) x", ("aligned",))
def rebalance_dates(spark, sf_dir):
    return rebalances(spark, sf_dir).select(d().alias("date"))


TRAIL = f"""select q.date as rebalance, f.symbol, f.date, f.daily_return from ({REB}) q join (select date, row_number() over (order by date) as k from (select distinct date from ({FULL}) a) b) n on n.date = q.date
 join (select date, row_number() over (order by date) as k from (select distinct date from ({FULL}) a) b) m on m.k between n.k - 60 and n.k - 1 join ({FULL}) f on f.date = m.date"""


def trailing(spark, sf_dir, returns=None):
    returns = universe(spark, sf_dir) if returns is None else returns
    return P.trailing(returns, P.rebalance_dates(returns, 60, "quarter").select("date"), 60)


@query(f"select cast(rebalance as varchar) as rebalance, symbol, count(*) as n, cast(min(date) as varchar) as first_date from ({TRAIL}) t group by 1, 2", ("aligned",))
def trailing_window(spark, sf_dir):
    return trailing(spark, sf_dir).groupBy(d("rebalance").alias("rebalance"), "symbol").agg(F.count(F.lit(1)).alias("n"), d(F.min("date")).alias("first_date"))


@query(f"select cast(x.rebalance as varchar) as rebalance, x.symbol as a, y.symbol as b, round(covar_samp(x.daily_return, y.daily_return), 8) as cov from ({TRAIL}) x join ({TRAIL}) y on x.rebalance = y.rebalance and x.date = y.date and x.symbol <= y.symbol group by 1, 2, 3", ("aligned",))
def covariance_per_rebalance(spark, sf_dir):
    return P.covariances(trailing(spark, sf_dir)).select(d("rebalance").alias("rebalance"), "a", "b", r("cov").alias("cov"))


INV = f"select rebalance, symbol, v / sum(v) over (partition by rebalance) as weight from (select rebalance, symbol, 1 / sqrt(greatest(var_samp(daily_return), 1e-12)) as v from ({TRAIL}) t group by 1, 2) x"


@query(f"select cast(rebalance as varchar) as rebalance, symbol, round(weight, 8) as weight from ({INV}) w", ("aligned",))
def weights_inverse_vol(spark, sf_dir):
    return P.inverse_vol_weights(trailing(spark, sf_dir)).select(d("rebalance").alias("rebalance"), "symbol", r("weight").alias("weight"))


@query(
    f"""select cast(rebalance as varchar) as rebalance, symbol, round(case when k = 0 then 1.0 / n when s > 0 then 1.0 / k else 0.0 end, 8) as weight from (select *, count(*) over (partition by rebalance) as n, sum(case when s > 0 then 1 else 0 end) over (partition by rebalance) as k
 from (select rebalance, symbol, sum(daily_return) as s from ({TRAIL}) t group by 1, 2) x) y""",
    ("aligned",),
)
def weights_tsmom(spark, sf_dir):
    return P.momentum_weights(trailing(spark, sf_dir)).select(d("rebalance").alias("rebalance"), "symbol", r("weight").alias("weight"))


@query(f"select cast(rebalance as varchar) as rebalance, symbol, round(1.0 / count(*) over (partition by rebalance), 8) as weight from (select distinct rebalance, symbol from ({TRAIL}) t) u", ("aligned",))
def weights_equal(spark, sf_dir):
    w = trailing(spark, sf_dir).select("rebalance", "symbol").distinct()
    return w.select(d("rebalance").alias("rebalance"), "symbol", r(1.0 / F.count(F.lit(1)).over(W.partitionBy("rebalance"))).alias("weight"))


@query()
def weights_risk_parity(spark, sf_dir):
    return P.solved_weights(trailing(spark, sf_dir), "risk_parity").select(d("rebalance").alias("rebalance"), "symbol", r("weight", 6).alias("weight"))


@query()
def weights_max_sharpe(spark, sf_dir):
    return P.solved_weights(trailing(spark, sf_dir), "max_sharpe").select(d("rebalance").alias("rebalance"), "symbol", r("weight", 6).alias("weight"))


BT = f"""
select date, symbol, value / sum(value) over (partition by date) as held, r, rebalance, weight, value * (1 + r) as after from (
 select f.date, f.symbol, greatest(f.daily_return, -1) as r, w.rebalance, w.weight, w.weight * coalesce(exp(sum(ln(1 + f.daily_return)) over (partition by w.rebalance, f.symbol order by f.date rows between unbounded preceding and 1 preceding)), 1) as value
 from ({FULL}) f asof join (select distinct rebalance from ({INV}) i) g on g.rebalance < f.date join ({INV}) w on w.rebalance = g.rebalance and w.symbol = f.symbol) x
"""


def tested(spark, sf_dir):
    returns = universe(spark, sf_dir)
    return P.backtest(returns, P.inverse_vol_weights(trailing(spark, sf_dir, returns)))


@query(
    f"""with bt as materialized ({BT}), ends as (select rebalance, symbol, arg_max(after, date) as e, max(weight) as w from bt group by 1, 2), drift as (select rebalance, symbol, w, e / sum(e) over (partition by rebalance) as dr from ends),
 turn as (select rebalance, sum(0.5 * abs(w - coalesce(p, 0)) * 0.0005) as cost from (select *, lag(dr) over (partition by symbol order by rebalance) as p from drift) z group by 1),
 firsts as (select rebalance, min(date) as first_date from bt group by 1)
 select cast(b.date as varchar) as date, round(sum(b.held * b.r) - max(case when b.date = f.first_date then t.cost else 0 end), 8) as net_return from bt b join turn t on t.rebalance = b.rebalance join firsts f on f.rebalance = b.rebalance group by b.date""",
    ("aligned",),
)
def walk_forward_backtest(spark, sf_dir):
    return tested(spark, sf_dir).groupBy(d().alias("date")).agg(r(F.first("net_return")).alias("net_return"))


@query(f"select cast(date as varchar) as date, symbol, round(held * r, 8) as contribution, round(held, 8) as weight from ({BT}) b", ("aligned",))
def contributions(spark, sf_dir):
    return tested(spark, sf_dir).select(d().alias("date"), "symbol", r("contribution").alias("contribution"), r("weight").alias("weight"))


@query(
    f"""with bt as materialized ({BT}), ends as (select rebalance, symbol, arg_max(after, date) as e, max(weight) as w from bt group by 1, 2), drift as (select rebalance, symbol, w, e / sum(e) over (partition by rebalance) as dr from ends),
 turn as (select sum(0.5 * abs(w - coalesce(p, 0)) * 0.0005) as cost from (select *, lag(dr) over (partition by symbol order by rebalance) as p from drift) z),
 g as (select date, symbol, held * r as c, sum(held * r) over (partition by date) as total from bt)
 select symbol, round(sum(c), 6) as contribution_to_return, round(covar_samp(c, total) / nullif(var_samp(total), 0), 6) as contribution_to_risk from g group by symbol
 union all select '(costs)', round(-cost, 6), 0.0 from turn""",
    ("aligned",),
)
def attribution_full(spark, sf_dir):
    return P.attribution(tested(spark, sf_dir)).select("symbol", r("contribution_to_return", 6).alias("contribution_to_return"), r("contribution_to_risk", 6).alias("contribution_to_risk"))


FIXED = {"Brand#1": 0.5, "Brand#2": 0.3, "Brand#3": 0.2}


@query(f"select distinct cast(rebalance as varchar) as rebalance, symbol, case symbol when 'Brand#1' then 0.5 when 'Brand#2' then 0.3 when 'Brand#3' then 0.2 else 0.0 end as weight from ({TRAIL}) t", ("aligned",))
def weights_fixed(spark, sf_dir):
    return P.fixed_weights(trailing(spark, sf_dir), FIXED).select(d("rebalance").alias("rebalance"), "symbol", "weight")


def signals(spark, sf_dir):
    w = X.by("symbol")
    x = daily(spark, sf_dir).where("daily_return is not null")
    return x.select("date", "symbol", "daily_return", F.lag("daily_return").over(w).alias("mu"), X.rolling(F.stddev_samp, "daily_return", X.last_n(w, 21), 5).alias("sigma"))


@query()
def ml_tilt_returns(spark, sf_dir):
    s = signals(spark, sf_dir)
    w = P.tilt_weights(s.select("date", "symbol", F.coalesce("mu", F.lit(0.0)).alias("mu"), "sigma"))
    return s.join(w, ["date", "symbol"]).groupBy(d().alias("date")).agg(r(F.sum(F.col("weight") * F.col("daily_return"))).alias("daily_return"), r(F.sum("weight"), 6).alias("total"))


@query(
    f"""select cast(date as varchar) as date, round(x * case when s is null then 1.0 when s > 0 then 1.0 else 0.8 end, 8) as daily_return from (select date, x, case when count(x) over w >= 20 then sum(x) over w end as s from (select date, avg(daily_return) as x from ({UNI}) u group by date) a
 window w as (order by date rows between 63 preceding and 1 preceding)) b""",
    ("daily",),
)
def ml_regime_returns(spark, sf_dir):
    """Levered by the sign of the quarter before: 1.2 capped at 1.0, 0.8 in a falling one."""
    e = P.equal_weight(daily(spark, sf_dir).where("daily_return is not null"))
    w = W.orderBy("date").rowsBetween(-63, -1)
    s = F.when(F.count("daily_return").over(w) >= 20, F.sum("daily_return").over(w))
    lever = F.when(s.isNull(), 1.0).when(s > 0, F.least(F.lit(1.2), F.lit(1.0))).otherwise(0.8)
    return e.select(d().alias("date"), r(F.col("daily_return") * lever).alias("daily_return"))


REPS, SEED = 2000, 7
#: Replicates of the query that returns the rows of all of them.
INDEX_REPS = 200


def mix_sql(x: str, seed: int) -> str:
    y = f"(({x}) * 48271 + {seed}) % 2147483647"
    y2 = f"((({y}) * ({y}) + 12345) % 2147483647)"
    y3 = f"(({y2} * 69621 + {seed}) % 2147483647)"
    return f"((({y3} * {y3} + 54321) % 2147483647) / 2147483647.0::double)"


def boot_sql(n: str, reps: int = REPS) -> str:
    x = f"rep * {n} + t"
    return f"""select rep, t, cast((last_value(s0 ignore nulls) over w + t - last_value(t0 ignore nulls) over w) % {n} as bigint) as i from (select rep, t, case when t = 0 or {mix_sql(x, SEED)} < 1.0::double / 21 then floor({mix_sql(x, SEED + 1)} * {n})::bigint end as s0,
 case when t = 0 or {mix_sql(x, SEED)} < 1.0::double / 21 then t end as t0 from range({reps}) a(rep), range({n}) b(t)) x window w as (partition by rep order by t rows between unbounded preceding and current row)"""


def boot_dates(spark, sf_dir):
    """The strategies' common dates."""
    s = strategies(spark, sf_dir)
    have = s.groupBy("date").agg(F.countDistinct("strategy").alias("k")).where("k = 3")
    return s.join(have.select("date"), "date", "left_semi")


#: The numbered common dates, how many there are, and every strategy's returns on them.
BOOT_CTES = """common as materialized (select date, row_number() over (order by date) - 1 as i from (select date from strat group by date having count(distinct strategy) = 3) z), size as materialized (select cast(count(*) as bigint) as n from common),
 returns as materialized (select s.strategy, s.daily_return, d.i from strat s join common d on d.date = s.date)"""
N = "(select n from size)"


def with_boot(body: str, reps: int = REPS) -> str:
    return f"with {BOOT_CTES}, draws as materialized ({boot_sql(N, reps)}), boot as materialized (select b.rep, d.strategy, d.daily_return from draws b join returns d on d.i = b.i) {body}"


@query(f"with {BOOT_CTES} select rep, t, i from ({boot_sql(N, INDEX_REPS)}) x", ("strat",))
def bootstrap_indices(spark, sf_dir):
    n = boot_dates(spark, sf_dir).select("date").distinct().count()
    return P.bootstrap_indices(spark, n, INDEX_REPS, SEED)


def boot(spark, sf_dir):
    return P.resampled(boot_dates(spark, sf_dir), REPS, SEED)


SH = "select rep, strategy, coalesce(avg(daily_return) / nullif(stddev_samp(daily_return), 0), 0) * sqrt(252.0) as s from boot b group by 1, 2"


@query(with_boot(f"select strategy, round(quantile_cont(s, 0.05), 5) as lo, round(quantile_cont(s, 0.95), 5) as hi, count(*) as n_boot from ({SH}) x group by strategy"), ("strat",))
def bootstrap_sharpe(spark, sf_dir):
    s = boot(spark, sf_dir).groupBy("rep", "strategy").agg(PF.sharpe("daily_return").alias("s"))
    return P.interval(s, ["strategy"], "s").select("strategy", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"), "n_boot")


@query(
    with_boot(f"""select x.strategy as a, y.strategy as b, round(quantile_cont(x.s - y.s, 0.05), 5) as lo, round(quantile_cont(x.s - y.s, 0.95), 5) as hi, round(least(1.0, 2 * least(avg(case when x.s - y.s <= 0 then 1.0 else 0.0 end), avg(case when x.s - y.s >= 0 then 1.0 else 0.0 end))), 8) as p
 from ({SH}) x join ({SH}) y on x.rep = y.rep and x.strategy < y.strategy group by 1, 2"""),
    ("strat",),
)
def bootstrap_sharpe_pairs(spark, sf_dir):
    s = boot(spark, sf_dir).groupBy("rep", "strategy").agg(PF.sharpe("daily_return").alias("s"))
    diff = series.pairs(s, "strategy", "rep", "s").withColumn("d", F.col("x") - F.col("y"))
    q = F.percentile("d", F.array(F.lit(0.05), F.lit(0.95)))
    return diff.groupBy("a", "b").agg(q.alias("q"), r(P.p_value(F.col("d"))).alias("p")).select("a", "b", r(F.col("q")[0], 5).alias("lo"), r(F.col("q")[1], 5).alias("hi"), "p")


@query(with_boot("select strategy, round(quantile_cont(g, 0.05), 5) as lo, round(quantile_cont(g, 0.95), 5) as hi from (select rep, strategy, exp(sum(ln(1 + daily_return)) * 252 / count(*)) - 1 as g from boot b group by 1, 2) x group by strategy"), ("strat",))
def bootstrap_return(spark, sf_dir):
    g = boot(spark, sf_dir).groupBy("rep", "strategy").agg(PF.annual_return("daily_return").alias("g"))
    return P.interval(g, ["strategy"], "g").select("strategy", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"))


# --- evaluation ----------------------------------------------------------------------------------


def rows_of(spark, sf_dir):
    return E.numbered(daily(spark, sf_dir).where("daily_return is not null"))


NUM = "select *, row_number() over (partition by symbol order by date) - 1 as i from daily where daily_return is not null"
FOLDS = f"""select symbol, cast(k as integer) as fold, k * 100 as train_from, k * 100 + 250 as train_to, k * 100 + 255 as test_from, least(k * 100 + 355, n) as test_to from (select symbol, count(*) as n from ({NUM}) z group by 1) a, range(0, 200) g(k)
 where n > 255 and k < ceil((n - 255) / 100.0)"""


@query(f"select symbol, fold, cast(train_from as bigint) as train_from, cast(train_to as bigint) as train_to, cast(test_from as bigint) as test_from, cast(test_to as bigint) as test_to from ({FOLDS}) f", ("daily",))
def walk_forward_split(spark, sf_dir):
    return E.folds(rows_of(spark, sf_dir), 250, 100, 5)


@query(f"select symbol, cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date from ({NUM}) x where i >= 250 group by symbol", ("daily",))
def feasible_date_range(spark, sf_dir):
    return rows_of(spark, sf_dir).where("i >= 250").groupBy("symbol").agg(d(F.min("date")).alias("first_date"), d(F.max("date")).alias("last_date"))


@query(f"select symbol, case when i >= n - size then 'holdout' else 'dev' end as slice, count(*) as n_rows from (select *, least(252, floor(n * 0.2)) as size from (select *, count(*) over (partition by symbol) as n from ({NUM}) x) y) z group by 1, 2", ("daily",))
def locked_holdout(spark, sf_dir):
    return E.holdout(rows_of(spark, sf_dir)).groupBy("symbol", "slice").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""select n.symbol, f.fold, count(*) as n, round(regr_intercept(n.y, n.x), 5) as b0, round(regr_slope(n.y, n.x), 5) as b1 from (select *, lead(vol_20d) over (partition by symbol order by date) as y, vol_20d as x from ({NUM}) a) n
 join ({FOLDS}) f on f.symbol = n.symbol and n.i >= f.train_from and n.i < f.train_to where n.x is not null and n.y is not null group by 1, 2""",
    ("daily",),
)
def har_ols(spark, sf_dir):
    """Next volatility on today's by least squares in every fold of every symbol."""
    rows = rows_of(spark, sf_dir).withColumn("y", F.lead("vol_20d").over(X.by("symbol"))).withColumn("x", F.col("vol_20d"))
    got = E.least_squares(rows, E.folds(rows, 250, 100, 5), ["x"], "y")
    return got.select("symbol", "fold", "n", r(F.col("coefficients")[0], 5).alias("b0"), r(F.col("coefficients")[1], 5).alias("b1"))


@query()
def ridge_forecast(spark, sf_dir):
    """Walk-forward ridge on lagged returns; out-of-sample figures by symbol."""
    w = X.by("symbol")
    names = ["l1", "l2", "l5"]
    rows = rows_of(spark, sf_dir).withColumns({"y": F.lead("daily_return").over(w), "l1": F.col("daily_return"), "l2": F.lag("daily_return", 1).over(w), "l5": F.lag("daily_return", 4).over(w)})
    f = E.folds(rows, 250, 100, 5)
    p = E.predicted(rows, f, E.least_squares(rows, f, names, "y", ridge=0.01), names).where("y is not null and pred is not null")
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.corr("pred", "y"), 5).alias("ic"), r(F.avg(F.when(F.signum("pred") == F.signum("y"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


ENS = "select symbol, date, 1 as horizon, daily_return as pred, 0.05 as ic from daily where daily_return is not null union all select symbol, date, 5, vol_20d / 100, 0.0 from daily where vol_20d is not null union all select symbol, date, 20, close / ma_50 - 1, 0.1 from daily"


@query(f"select symbol, cast(date as varchar) as date, round(avg(pred), 8) as mean, round(median(pred), 8) as median, round(sum(greatest(ic, 0.01) * pred) / sum(greatest(ic, 0.01)), 8) as weighted from ({ENS}) e group by 1, 2", ("daily",))
def horizon_ensemble(spark, sf_dir):
    x = daily(spark, sf_dir)
    part = lambda h, p, ic: x.select("symbol", "date", F.lit(h).alias("horizon"), p.alias("pred"), F.lit(ic).alias("ic")).where("pred is not null")
    every = part(1, F.col("daily_return"), 0.05).unionByName(part(5, F.col("vol_20d") / 100, 0.0)).unionByName(part(20, F.col("close") / F.col("ma_50") - 1, 0.1))
    return E.horizon_ensemble(every).select("symbol", d().alias("date"), *(r(c).alias(c) for c in ("mean", "median", "weighted")))


#: A volatility forecast that SQL can say, too: the mean of the five values before against the one twenty before; a fold is a year.
VF = "select symbol, date, extract(year from date) as fold, vol_20d as y, avg(vol_20d) over (partition by symbol order by date rows between 5 preceding and 1 preceding) as p, lag(vol_20d, 20) over (partition by symbol order by date) as b from daily where vol_20d is not null"
QL = lambda x: f"(power(greatest({x}, 0.002) / greatest(y, 0.002), 2) - ln(power(greatest({x}, 0.002) / greatest(y, 0.002), 2)) - 1)"
VM = f"""select a.*, f.n_folds, f.folds_passed from (select symbol, count(*) as n_obs, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) as oos_r2, avg({QL('p')}) / nullif(avg({QL('b')}), 0) as qlike_skill_ratio from ({VF}) v where p is not null and b is not null group by symbol) a
 join (select symbol, count(*) as n_folds, sum(case when q < b then 1 else 0 end) as folds_passed from (select symbol, fold, avg({QL('p')}) as q, avg({QL('b')}) as b from ({VF}) v where p is not null and b is not null group by 1, 2) g group by symbol) f on f.symbol = a.symbol"""


@query(
    f"""select symbol, reasons = '' as cleared, reasons from (select symbol, case when n_obs is null or oos_r2 is null or qlike_skill_ratio is null or n_folds is null or folds_passed is null then 'missing' when oos_r2 > 1 or qlike_skill_ratio < 0 or n_folds < 1 or folds_passed < 0 or folds_passed > n_folds or n_obs < 0 then 'implausible'
 else concat_ws(',', case when oos_r2 >= 0.1 then null else 'oos_r2' end, case when qlike_skill_ratio < 0.99 then null else 'qlike_skill_ratio' end, case when folds_passed >= ceil(0.6 * n_folds) then null else 'folds_passed' end, case when n_obs >= 250 then null else 'n_obs' end) end as reasons from ({VM}) m) x""",
    ("daily",),
)
def skill_verdict(spark, sf_dir):
    """All rules of the skill gate on a forecast by the mean of the five values before."""
    from ..operators import volatility as V

    w = X.by("symbol")
    rows = daily(spark, sf_dir).where("vol_20d is not null").select("symbol", F.year("date").alias("fold"), F.col("vol_20d").alias("y"), F.avg("vol_20d").over(X.before_n(w, 5)).alias("p"), F.lag("vol_20d", 20).over(w).alias("b")).where("p is not null and b is not null")
    r2 = 1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("p"), F.lit(2.0))), F.var_pop("y") * F.count("y"))
    q, b = F.avg(V.qlike("y", "p")), F.avg(V.qlike("y", "b"))
    whole = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_obs"), r2.alias("oos_r2"), F.try_divide(q, b).alias("qlike_skill_ratio"))
    folds = rows.groupBy("symbol", "fold").agg((q < b).cast("int").alias("ok")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_folds"), F.sum("ok").alias("folds_passed"))
    got = E.skill_gate(whole.join(folds, "symbol"))
    kind = F.get("reasons", F.lit(0))
    reasons = F.when(F.coalesce(kind.startswith("missing"), F.lit(False)), "missing").when(F.coalesce(kind.startswith("implausible"), F.lit(False)), "implausible").otherwise(F.array_join("reasons", ","))
    return got.select("symbol", "cleared", reasons.alias("reasons"))


# --- contracts -----------------------------------------------------------------------------------


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def check_unique_grain(spark, sf_dir):
    return C.unique_grain(bars.scan(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("select 'value not null' as contract, cast(sum(case when value is null then 1 else 0 end) as bigint) as violations from events union all select 'event_type accepted', cast(sum(case when event_type not in ('click', 'view') then 1 else 0 end) as bigint) from events union all select 'user_id unique', count(user_id) - count(distinct user_id) from events union all select 'event_id unique', count(event_id) - count(distinct event_id) from events")
def check_not_null(spark, sf_dir):
    return C.column_checks(bars.scan(spark, sf_dir, "events"), ["value"], {"event_type": ["click", "view"]}, ["user_id", "event_id"])


@query("select symbol, cast(date as varchar) as date, round(daily_return, 8) as daily_return from daily where abs(daily_return) > 0.1", ("daily",))
def check_bounds(spark, sf_dir):
    return C.bounds(daily(spark, sf_dir), "daily_return", 0.1).select("symbol", d().alias("date"), r("daily_return").alias("daily_return"))


@query("select symbol, cast(date as varchar) as date from daily where not coalesce(vol_20d <= daily_return * 20, false)", ("daily",))
def check_ci_ordered(spark, sf_dir):
    return C.interval_ordered(daily(spark, sf_dir).withColumns({"lo": F.col("vol_20d"), "hi": F.col("daily_return") * 20})).select("symbol", d().alias("date"))


@query("select symbol, cast(date as varchar) as date from (select *, (low - 100 > 0 or high - 100 < 0) as expected, close > 100 as flag from prices) p where flag <> expected", ("prices",))
def check_pairs(spark, sf_dir):
    p = bars.prices(spark, sf_dir).withColumns({"diff": F.col("high") - F.col("low"), "lo": F.col("low") - 100, "hi": F.col("high") - 100, "flag": F.col("close") > 100})
    return C.pair_consistent(p, "high", "low", "diff", "lo", "hi", "flag").select("symbol", d().alias("date"))


@query("select l_orderkey, round(sum(l_extendedprice), 2) as parts from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey having abs(sum(l_extendedprice) - max(o_totalprice)) > 1000")
def check_reconcile(spark, sf_dir):
    x = bars.scan(spark, sf_dir, "lineitem").join(bars.scan(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return C.reconciles(x, ["l_orderkey"], "l_extendedprice", "o_totalprice", 1000).select("l_orderkey", r("parts", 2).alias("parts"))


@query("select strategy, cast(date as varchar) as date from strat s where not exists (select 1 from strat t where t.date = s.date and t.strategy <> s.strategy)", ("strat",))
def check_period_aligned(spark, sf_dir):
    s = strategies(spark, sf_dir)
    alone = s.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.first("strategy").alias("strategy")).where("n = 1")
    return alone.select("strategy", d().alias("date"))


@query("select series_id from (select distinct series_id from macro) m where series_id not in ('DGS10', 'DGS2')", ("macro",))
def check_allowlist(spark, sf_dir):
    return C.allowlist(bars.macro(spark, sf_dir), "series_id", spark.createDataFrame([("DGS10",), ("DGS2",)], "series_id string"))


@query("select symbol, cast(max(date) as varchar) as latest from prices group by symbol having date '2002-01-01' - max(date) > 60", ("prices",))
def check_freshness(spark, sf_dir):
    return C.fresh(bars.prices(spark, sf_dir), "symbol", "date", "2002-01-01", 60).select("symbol", d("latest").alias("latest"))


@query("select event_type, cast(cast(ts as date) as varchar) as day, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def incremental_load(spark, sf_dir):
    """The events as a bounded stream of files, merged batch by batch by type and day; each folder is a
    new one below the shared folder."""
    base = incremental.shared_folder(spark)
    e = bars.scan(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "ts", "event_id")
    landing = incremental.scratch(base, "landing")
    e.repartition(3).write.parquet(landing)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    t = incremental.ParquetTable(spark, incremental.scratch(base, "table"), e.schema, order)
    incremental.incremental_load(spark, landing, t, ["event_type", "day"], incremental.scratch(base, "state"))
    return t.read().select("event_type", "day", "event_id")


@query("select cast(event_id % 3 as bigint) as batch_id, count(*) as rows, 'ok' as status from events group by 1")
def load_audit(spark, sf_dir):
    """The audit of three loads, each by a stream of its own with the same checkpoint: a third of the events each."""
    base = incremental.shared_folder(spark)
    e = bars.scan(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "ts", "event_id")
    landed, table, state = (incremental.scratch(base, n) for n in ("landing", "table", "state"))
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(landed)
        t = incremental.ParquetTable(spark, table, e.schema, [F.col("ts").desc(), F.col("event_id").desc()])
        audit = incremental.incremental_load(spark, landed, t, ["event_type", "day"], state)
    return audit.select("batch_id", "rows", "status")


#: Events arrive up to two days after their time, every 20th 45 days late; deliveries are fifths of the table's span.
TICKS = """select *, least(4, floor((epoch(ts) - t0 + 86400 * case when event_id % 20 = 0 then 45 else event_id % 3 end) / ((t1 - t0 + 1) / 5))) as delivery from events, (select epoch(min(ts)) as t0, epoch(max(ts)) as t1 from events) z where value is not null"""


@query(
    f"""with ticks as materialized ({TICKS}), sent as materialized (select delivery, max(epoch(ts)) as top from ticks group by 1),
 kept as (select t.*, epoch(date_trunc('day', ts)) + 86400 as day_end from ticks t where epoch(date_trunc('day', ts)) + 86400 > coalesce((select max(top) - 172800 from sent s where s.delivery < t.delivery), -1e18))
 select event_type, cast(cast(ts as date) as varchar) as day, round(arg_min(value, (ts, event_id)), 8) as open, round(max(value), 8) as high, round(min(value), 8) as low, round(arg_max(value, (ts, event_id)), 8) as close, count(*) as n
 from kept where day_end <= (select max(top) - 172800 from sent) group by 1, 2"""
)
def live_bars(spark, sf_dir):
    """Daily bars of a stream in five deliveries, restarted for each: later ticks of an open day supersede, ticks of closed days are dropped."""
    base = incremental.shared_folder(spark)
    e = bars.scan(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    span = e.agg(F.unix_micros(F.min("ts")).alias("t0"), F.unix_micros(F.max("ts")).alias("t1"))
    delay = F.when(F.col("event_id") % 20 == 0, 45).otherwise(F.col("event_id") % 3) * F.lit(86_400_000_000)
    part = F.least(F.lit(4), F.floor((F.unix_micros("ts") - F.col("t0") + delay) / ((F.col("t1") - F.col("t0") + 1_000_000) / 5)))
    sent = e.crossJoin(F.broadcast(span)).withColumn("delivery", part).drop("t0", "t1")  # one row
    landed, sink, state = (incremental.scratch(base, n) for n in ("ticks", "bars", "bars-state"))
    for k in range(5):
        sent.where(F.col("delivery") == k).drop("delivery").coalesce(1).write.mode("append").parquet(landed)
        got = live.publish(spark, landed, e.schema, sink, state, ["event_type"], "ts", "value", "event_id")
    return got.select("event_type", d("day").alias("day"), *(r(c).alias(c) for c in ("open", "high", "low", "close")), "n")
