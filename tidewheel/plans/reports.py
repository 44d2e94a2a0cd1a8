"""Reports on runs: metrics of a rolling fit as a table, its robustness around a base, skill against an EWMA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as X
from ..operators import evaluation as E
from ..operators import series
from ..operators import volatility as V
from .analytics import VOLS, vols
from .models import ahead, kept, runs
from .registry import daily, query, r

#: Pairs that a line is fitted on, at least.
LEAST = 60
#: One knob changed at a time, declared before any run.
LINE_BASE = {"train": 252, "horizon": 1}
LINE_PROBES = {"train_size": [{"train": 126}, {"train": 504}], "horizon": [{"horizon": 2}, {"horizon": 5}]}


def known(x: str, horizon: int) -> F.Column:
    """The sum over the last rows, where all of them are there."""
    return X.rolling(F.sum, x, X.by("symbol").rowsBetween(1 - horizon, 0), horizon)


def sums(horizon: int) -> dict[str, F.Column]:
    """Running sums of the pairs (return, return of the rows after it) that are known at a row: one step a row, whatever the training length."""
    x, y = F.col(f"x{horizon}"), F.col(f"k{horizon}")
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xy": x * y, "xx": x * x}
    so_far = X.by("symbol").rowsBetween(X.W.unboundedPreceding, 0)
    return {f"{name}_{horizon}": F.sum(F.when(x.isNotNull() & y.isNotNull(), v).otherwise(0.0)).over(so_far) for name, v in terms.items()}


def line(horizon: int, train: int) -> F.Column:
    """The forecast of the next rows' return: the least-squares line on today's return, over the last ``train`` rows' pairs."""
    n, x, y, xy, xx = (F.col(f"{c}_{horizon}") - F.coalesce(F.lag(f"{c}_{horizon}", train).over(X.by("symbol")), F.lit(0.0)) for c in ("n", "x", "y", "xy", "xx"))
    slope = F.try_divide(n * xy - x * y, n * xx - x * x)
    return F.when(n >= LEAST, F.try_divide(y - slope * x, n) + slope * F.col("daily_return"))


def line_runs(spark, sf_dir, every: list[tuple[str, str, dict]]):
    """symbol, date, dimension, probe, horizon, y, pred, vol for every run: all frames share one sort by symbol and date."""
    w = X.by("symbol")
    horizons = sorted({c["horizon"] for *_, c in every})
    rows = daily(spark, sf_dir).where("daily_return is not null").select("symbol", "date", "daily_return")
    rows = rows.withColumns({f"x{h}": F.lag("daily_return", h).over(w) for h in horizons} | {f"k{h}": known("daily_return", h) for h in horizons} | {f"y{h}": ahead("daily_return", h) for h in horizons})
    rows = rows.withColumns({k: v for h in horizons for k, v in sums(h).items()})
    rows = rows.withColumns({f"p{h}_{t}": line(h, t) for h, t in sorted({(c["horizon"], c["train"]) for *_, c in every})})
    each = F.array(*(F.struct(F.lit(a).alias("dimension"), F.lit(b).alias("probe"), F.lit(c["horizon"]).alias("horizon"), F.col(f"y{c['horizon']}").alias("y"), F.col(f"p{c['horizon']}_{c['train']}").alias("pred")) for a, b, c in every))
    return rows.select("symbol", "date", F.inline(each)).withColumn("vol", F.lit(None).cast("double"))


def line_sql(horizon: int, train: int) -> str:
    h = horizon
    return f"""select symbol, date, y, a + b * x as pred from (select symbol, date, daily_return as x, case when count(daily_return) over nx = {h} then sum(daily_return) over nx end as y, regr_count(k, l) over f as n, regr_intercept(k, l) over f as a, regr_slope(k, l) over f as b
 from (select symbol, date, daily_return, lag(daily_return, {h}) over w as l, case when count(daily_return) over p = {h} then sum(daily_return) over p end as k from daily where daily_return is not null
 window w as (partition by symbol order by date), p as (partition by symbol order by date rows between {h - 1} preceding and current row)) q
 window nx as (partition by symbol order by date rows between 1 following and {h} following), f as (partition by symbol order by date rows between {train - 1} preceding and current row)) z where n >= {LEAST} and y is not null"""


METRICS_SQL = """select {keys}, count(*) as n, coalesce(corr(pred, y), 0) as ic, avg(case when sign(pred) = sign(y) and y <> 0 then 1.0 else 0.0 end) as direction_accuracy, greatest(avg(case when y > 0 then 1.0 else 0.0 end), avg(case when y < 0 then 1.0 else 0.0 end)) as baseline_direction_accuracy,
 avg(case when pred > 0 then 1.0 else 0.0 end) as positive_prediction_rate, avg(sign(pred) * y) as m, stddev_pop(sign(pred) * y) as sd from ({rows}) m group by {keys} having count(*) >= 5"""
TABLE = ("ic", "direction_accuracy", "baseline_direction_accuracy", "direction_edge", "positive_prediction_rate", "sharpe", "r2", "n_obs")


@query(
    f"""select symbol, round(ic, 6) as ic, round(direction_accuracy, 6) as direction_accuracy, round(baseline_direction_accuracy, 6) as baseline_direction_accuracy, round(direction_accuracy - baseline_direction_accuracy, 6) as direction_edge, round(positive_prediction_rate, 6) as positive_prediction_rate,
 round(case when n > 1 and sd > 0 then m / sd * sqrt(252.0) end, 5) as sharpe, round(sign(ic) * ic * ic, 6) as r2, cast(n as double) as n_obs from ({METRICS_SQL.format(keys="symbol", rows=line_sql(1, 252))}) x order by ic desc nulls last, direction_accuracy desc nulls last""",
    ("daily",),
)
def performance_table(spark, sf_dir):
    """Metrics of the fitted line as rows of (model, symbol, metric, value), and the table that a reader sees of them."""
    got = E.evaluated(kept(line_runs(spark, sf_dir, runs(LINE_BASE, {}))), ["symbol", "horizon"]).withColumnRenamed("n", "n_obs")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in TABLE))
    wide = E.metrics_table(got.select(F.lit("return_line").alias("model"), "symbol", F.inline(each)), TABLE)
    return wide.select("symbol", *(r(m, 5 if m == "sharpe" else 6).alias(m) for m in TABLE))


REPORTED = ("ic", "direction_accuracy", "r2")
RUNS_SQL = " union all ".join(f"select '{a}' as dimension, '{b}' as probe, * from ({line_sql(c['horizon'], c['train'])}) r{k}" for k, (a, b, c) in enumerate(runs(LINE_BASE, LINE_PROBES)))
LONG_SQL = " union all ".join(f"select symbol, dimension, '{m}' as metric, {'sign(ic) * ic * ic' if m == 'r2' else m} as v from got" for m in REPORTED)


RUNS_CTE = f"with got as materialized ({METRICS_SQL.format(keys='symbol, dimension, probe', rows=RUNS_SQL)}), long as ({LONG_SQL})"
PAIRED = "long p left join long b on b.dimension = 'base' and b.symbol = p.symbol and b.metric = p.metric where p.dimension <> 'base'"


def line_fragility(spark, sf_dir):
    """Every dimension and metric of the fitted line against its base run."""
    got = E.evaluated(kept(line_runs(spark, sf_dir, runs(LINE_BASE, LINE_PROBES))), ["symbol", "dimension", "probe", "horizon"])
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in REPORTED))
    return E.fragility(kept(got.select("symbol", "dimension", "probe", F.lit(None).cast("boolean").alias("cleared"), F.inline(each))), ["symbol"])


@query(
    f"""{RUNS_CTE} select p.symbol, p.dimension, p.metric, round(max(b.v), 6) as base, round(min(p.v), 6) as lo, round(max(p.v), 6) as hi, round(avg(p.v), 6) as mean, round(max(abs(p.v - b.v)), 6) as spread, count(p.v) as n_probes from {PAIRED} group by 1, 2, 3""",
    ("daily",),
)
def robustness_aggregate(spark, sf_dir):
    """Base, least, greatest and mean value and the largest move from the base, of the probes of each dimension and metric."""
    return line_fragility(spark, sf_dir).select("symbol", "dimension", "metric", *(r(c, 6).alias(c) for c in ("base", "lo", "hi", "mean")), r("swing", 6).alias("spread"), "n_probes")


LEVEL = " ".join(f"when '{m}' then {E.NO_SKILL[m]}" for m in REPORTED if m in E.NO_SKILL)


@query(
    f"""{RUNS_CTE} select symbol, dimension, metric, concat_ws(',', case when base is null then 'no_base' end, case when crossed then 'sign_flip' end, case when swing > 0.05 then 'large_swing' end, case when base is not null and n < 1 then 'no_probes' end) as flags,
 case when coalesce(crossed, false) or coalesce(swing > 0.05, false) then 'fragile' when base is null or n < 1 then 'inconclusive' else 'robust' end as verdict
 from (select p.symbol, p.dimension, p.metric, max(b.v) as base, count(p.v) as n, max(abs(p.v - b.v)) as swing, bool_or((b.v - level) * (p.v - level) < 0) as crossed from (select *, case metric {LEVEL} end as level from long) p
 left join long b on b.dimension = 'base' and b.symbol = p.symbol and b.metric = p.metric where p.dimension <> 'base' group by 1, 2, 3) x""",
    ("daily",),
)
def robustness_classify(spark, sf_dir):
    """Flags and verdict of each dimension and metric of the fitted line's runs."""
    return line_fragility(spark, sf_dir).select("symbol", "dimension", "metric", F.array_join("flags", ",").alias("flags"), "verdict")


#: Every training length with every horizon.
SWEEP = [("sweep", f"{h}_{t}", {"train": t, "horizon": h}) for h in (1, 2, 5) for t in (126, 252, 504)]
SWEEP_SQL = " union all ".join(f"select {c['horizon']} as horizon, {c['train']} as train, * from ({line_sql(c['horizon'], c['train'])}) r{k}" for k, (_, _, c) in enumerate(SWEEP))


@query(
    f"""select symbol, horizon, train, round(ic, 6) as ic, round(direction_accuracy, 6) as direction_accuracy, n as n_obs from ({METRICS_SQL.format(keys="symbol, horizon, train", rows=SWEEP_SQL)}) x order by x.ic desc nulls last, symbol, horizon, train limit 10""",
    ("daily",),
)
def sweep_top_k(spark, sf_dir):
    """The ten configurations of the fitted line with the highest correlation, of all symbols, horizons and training lengths."""
    got = E.evaluated(kept(line_runs(spark, sf_dir, SWEEP)), ["symbol", "probe", "horizon"]).withColumn("train", F.split("probe", "_")[1].cast("int"))
    best = got.orderBy(F.desc_nulls_last("ic"), "symbol", "horizon", "train").limit(10)
    return best.select("symbol", "horizon", "train", r("ic", 6).alias("ic"), r("direction_accuracy", 6).alias("direction_accuracy"), F.col("n").alias("n_obs"))


@query(
    f"""{RUNS_CTE}, judged as (select p.symbol, p.dimension, p.metric, case when bool_or((b.v - level) * (p.v - level) < 0) or max(abs(p.v - b.v)) > 0.05 then 'fragile' when max(b.v) is null or count(p.v) < 1 then 'inconclusive' else 'robust' end as v
 from (select *, case metric {LEVEL} end as level from long) p left join long b on b.dimension = 'base' and b.symbol = p.symbol and b.metric = p.metric where p.dimension <> 'base' group by 1, 2, 3)
 select symbol, case when bool_or(v = 'fragile') then 'fragile' when bool_and(v = 'robust') then 'robust' else 'inconclusive' end as verdict, count(*) as n_judged from judged group by symbol""",
    ("daily",),
)
def overall_verdict(spark, sf_dir):
    """A symbol's verdict over all dimensions and metrics of the fitted line: one fragile makes it fragile, only all robust make it robust."""
    v = F.col("verdict")
    worst = F.when(F.bool_or(v == "fragile"), "fragile").when(F.bool_and(v == "robust"), "robust").otherwise("inconclusive")
    return line_fragility(spark, sf_dir).groupBy("symbol").agg(worst.alias("overall"), F.count(F.lit(1)).alias("n_judged")).withColumnRenamed("overall", "verdict")


FOLDS = 5


def loss_sql(pred: str) -> str:
    rho = f"power(greatest({pred}, {V.FLOOR}) / greatest(a, {V.FLOOR}), 2)"
    return f"{rho} - ln({rho}) - 1"


@query(
    f"""with recursive v as materialized (select symbol, date, p, a, row_number() over (partition by symbol order by date) as i, count(*) over (partition by symbol) as n from ({VOLS}) v where p is not null and a is not null),
 e as (select symbol, i, a as s from v where i = 1 union all select v.symbol, v.i, 0.94 * e.s + 0.06 * v.a from e join v on v.symbol = e.symbol and v.i = e.i + 1),
 f as (select v.symbol, floor((v.i - 1 - (n - {FOLDS} * (n // {FOLDS + 1}))) / nullif(n // {FOLDS + 1}, 0)) as fold, {loss_sql("p")} as q, {loss_sql("e.s")} as b from v join e on e.symbol = v.symbol and e.i = v.i - 1 where v.i > n - {FOLDS} * (n // {FOLDS + 1})),
 g as (select symbol, sum(q) as q, sum(b) as b, avg(q) < avg(b) as ok from f group by symbol, fold)
 select symbol, count(*) as n_folds, cast(sum(case when ok then 1 else 0 end) as bigint) as passed, round(sum(q) / nullif(sum(b), 0), 6) as ratio from g group by symbol""",
    ("daily",),
)
def qlike_skill_ratio(spark, sf_dir):
    """QLIKE of yesterday's volatility over that of the EWMA known yesterday, on five test folds of equal size after a first stretch, and the folds in which it is lower."""
    v = vols(spark, sf_dir)
    w = X.by("symbol")
    base = series.ewma(v.select("symbol", "date", "p", "a"), "symbol", "a")
    own = base.withColumns({"base": F.lag("ewma").over(w), "j": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(X.W.partitionBy("symbol"))})
    own = own.withColumn("size", F.floor(F.col("n") / (FOLDS + 1))).withColumn("j", F.col("j") - (F.col("n") - FOLDS * F.col("size"))).where("j >= 0 and base is not null")
    own = own.select("symbol", F.floor(F.try_divide("j", "size")).alias("fold"), V.qlike("a", "p").alias("q"), V.qlike("a", "base").alias("b"))
    folds = own.groupBy("symbol", "fold").agg(F.sum("q").alias("q"), F.sum("b").alias("b"), (F.avg("q") < F.avg("b")).cast("long").alias("ok"))
    return folds.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_folds"), F.sum("ok").alias("passed"), r(F.try_divide(F.sum("q"), F.sum("b")), 6).alias("ratio"))
