"""Fitted models: boosted trees by fold, nested tuning, importances, calibrated forecasts, p-values, robustness of gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as X
from ..functions.scalars import correlation, correlation_p
from ..operators import boosting as BT
from ..operators import evaluation as E
from ..operators import features as FT
from ..operators import portfolio as P
from ..operators import volatility as V
from ..sources import landing
from ..streaming.incremental import scratch, shared_folder
from .analytics import PRED, predictions
from .portfolios import NUM, rows_of, trailing, universe
from .registry import d, daily, query, r
from .research import METRICS, vol_rows

HORIZONS = (1, 5, 20)
DEFAULT = FT.names("default")


def kept(df):
    """``df`` written once below the shared folder: several plans read it."""
    return landing.written(df, scratch(shared_folder(df.sparkSession), "rows"))


def ahead(column: str, horizon: int):
    """The sum over the next rows, where all of them are there."""
    return X.rolling(F.sum, column, X.by("symbol").rowsBetween(1, horizon), horizon)


def featured(spark, sf_dir):
    """The default features of all symbols with the returns over the next 1, 5 and 20 rows."""
    x = daily(spark, sf_dir)
    vol = X.rolling(F.stddev_samp, "daily_return", X.last_n(X.by("symbol"), 20), 5)
    rows = x.select("symbol", "date", "daily_return", vol.alias("vol"), *(ahead("daily_return", h).alias(f"y{h}") for h in HORIZONS))
    return FT.feature_set(x, "default").join(rows, ["symbol", "date"])


def rounded(df, keys, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*keys, *(r(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys))


@query()
def return_forecast_eval(spark, sf_dir):
    """Boosted forecasts of three horizons by folds of 252 rows after 252, a new one every 126 rows, so that a row is forecast by two windows: the
    metrics of the mean and of the median of its forecasts, and how many folds went with the target."""
    rows = featured(spark, sf_dir)
    out = BT.walk_forward(rows, {h: f"y{h}" for h in HORIZONS}, DEFAULT, step=126)
    keys = ["symbol", "horizon"]
    one = BT.combined(out, keys).join(rows.select("symbol", "date", "vol"), ["symbol", "date"])
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ensemble"), F.col(k).alias("pred")) for k in ("mean", "median"))))
    long = one.select(*keys, "date", "y", "vol", each.alias("e")).select(*keys, "date", "y", "vol", "e.*")
    got = E.evaluated(long, [*keys, "ensemble"]).join(E.fold_counts(out, keys), keys)
    return rounded(got, [*keys, "ensemble"])


WINDOWS = "select symbol, cast(k as integer) as fold, k * 50 as train_from, k * 50 + 250 as train_to, least(k * 50 + 350, n) as test_to from (select symbol, count(*) as n from (select * from rows_ where y is not null) u group by 1) a, range(0, 400) g(k) where n > 250 and k < ceil((n - 250) / 50.0)"


@query(
    f"""with base as materialized (select symbol, date, x, y from (select symbol, date, daily_return as x, lead(daily_return) over (partition by symbol order by date) as y from ({NUM}) a) b where y is not null),
 rows_ as materialized (select *, row_number() over (partition by symbol order by date) - 1 as i from base), w as materialized ({WINDOWS}),
 m as materialized (select w.symbol, w.fold, regr_intercept(r.y, r.x) as b0, regr_slope(r.y, r.x) as b1 from w join rows_ r on r.symbol = w.symbol and r.i >= w.train_from and r.i < w.train_to group by 1, 2)
 select r.symbol, cast(r.date as varchar) as date, round(avg(b0 + b1 * r.x), 8) as mean, round(median(b0 + b1 * r.x), 8) as median, count(*) as n_windows from w join m on m.symbol = w.symbol and m.fold = w.fold join rows_ r on r.symbol = w.symbol and r.i >= w.train_to and r.i < w.test_to group by 1, 2""",
    ("daily",),
)
def overlapping_windows(spark, sf_dir):
    """Each day forecast by the two windows that test it: their mean and median. The model is a line through the day before."""
    rows = daily(spark, sf_dir).where("daily_return is not null").select("symbol", "date", F.col("daily_return").alias("x"), F.lead("daily_return").over(X.by("symbol")).alias("y")).where("y is not null")
    rows = E.numbered(rows)
    f = E.folds(rows, 250, 100, step=50)
    out = E.predicted(rows, f, E.least_squares(rows, f, ["x"], "y"), ["x"])
    return BT.combined(out, ["symbol"]).select("symbol", d().alias("date"), r("mean").alias("mean"), r("median").alias("median"), "n_windows")


@query()
def gb_volatility(spark, sf_dir):
    """Boosted trees on the volatility features in the five expanding folds and the locked holdout of vol_backtest: the same metrics."""
    out = boosted_parts(kept(V.with_base(V.parted(V.sliced(vol_rows(spark, sf_dir))))), BT.Boost(rounds=100, depth=3), F.lit(6))
    return V.scores(out).select("symbol", F.col("n_obs").cast("long").alias("n_obs"), "n_folds", "folds_passed", "holdout_n_obs", *(r(m, 6).alias(m) for m in METRICS))


@query()
def tune_grid(spark, sf_dir):
    """Ridge forecasts of the next five rows whose penalty is chosen by three inner folds of each training part; figures of the outer test rows,
    which no choice has seen, and how often each penalty was chosen."""
    rows = featured(spark, sf_dir).dropna("any", subset=["y5", *DEFAULT]).withColumnRenamed("y5", "y")
    rows = E.numbered(rows)
    f = E.folds(rows, 252, 100, 4)
    models = E.nested_ridge(rows, f, DEFAULT, "y")
    out = E.predicted(rows, f, models, DEFAULT)
    chosen = models.groupBy("symbol").agg(*(F.count(F.when(F.col("ridge") == p, 1)).alias(f"chose_{str(p).replace('.', '_')}") for p in E.PENALTIES))
    got = out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), correlation("pred", "y").alias("ic"), (1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("pred"), F.lit(2.0))), F.var_pop("y") * F.count("y"))).alias("r2"))
    return got.join(chosen, "symbol").select("symbol", "n", r("ic", 5).alias("ic"), r("r2", 5).alias("r2"), *[c for c in chosen.columns if c != "symbol"])


def latest_rows(spark, sf_dir, train=252):
    """The last rows of each symbol with a known target, in order."""
    w = W.partitionBy("symbol").orderBy(F.col("date").desc())
    rows = featured(spark, sf_dir).where(F.coalesce(*DEFAULT).isNotNull() & F.col("y5").isNotNull()).withColumn("back", F.row_number().over(w)).where(F.col("back") <= train)
    return rows.withColumns({"i": (train - F.col("back")).cast("long"), "y": F.col("y5")})


@query()
def feature_importance(spark, sf_dir):
    """How much R squared of each symbol's last model falls when a feature is permuted, the mean of three seeded permutations."""
    return BT.importances(latest_rows(spark, sf_dir), ["symbol"], DEFAULT).select("symbol", "feature", r("importance").alias("importance"))


@query()
def top_k_importance(spark, sf_dir):
    """The five features of each symbol that matter most."""
    got = BT.importances(latest_rows(spark, sf_dir), ["symbol"], DEFAULT)
    w = W.partitionBy("symbol").orderBy(F.col("importance").desc(), "feature")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5).select("symbol", "rank", "feature", r("importance").alias("importance"))


@query()
def latest_forecast(spark, sf_dir):
    """Each symbol's next five rows by a boosted model tuned on its last 252 rows, calibrated and bounded."""
    rows = featured(spark, sf_dir).withColumn("y", F.col("y5"))
    got = BT.latest(rows, DEFAULT, horizon=5)
    return got.select("symbol", d().alias("as_of"), *(r(c).alias(c) for c in ("raw", "train_mean", "bound", "calibrated")))


@query(
    f"""select symbol, n, round(ic, 6) as ic, round(case when ic is null or n < 3 then 1 else coalesce(tail / whole, 1) end, 6) as p_value from (select symbol, n, ic, list_sum(list_transform(range(0, 4001), lambda k: case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end * power(greatest(0, 1 - power(abs(ic) + (1 - abs(ic)) * k / 4000.0, 2)), (n - 4) / 2.0))) * (1 - abs(ic)) / 12000 as tail,
 list_sum(list_transform(range(0, 4001), lambda k: case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end * power(greatest(0, 1 - power(k / 4000.0, 2)), (n - 4) / 2.0))) / 12000 as whole from (select symbol, count(*) as n, corr(pred, actual) as ic from ({PRED}) p where pred is not null and actual is not null group by symbol) a) b""",
    ("daily",),
)
def ic(spark, sf_dir):
    """The information coefficient with its two-sided p-value (in SQL: Simpson's rule on the density of the coefficient)."""
    got = predictions(spark, sf_dir).where("pred is not null and actual is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), correlation("pred", "actual").alias("ic"))
    return got.select("symbol", "n", r("ic", 6).alias("ic"), r(correlation_p("ic", "n"), 6).alias("p_value"))


PENALTIES = (0.01, 0.1, 1.0)
VOL_MODELS = {"rv_har": (0.0, 0.0)} | {f"rv_ridge {a}": (a, 0.0) for a in PENALTIES} | {f"rv_lasso {a}": (0.0, a) for a in PENALTIES}


def boosted_parts(own, how, last):
    """Forecasts by boosted trees of rows with their part: each part up to ``last`` by a model of all rows before it."""
    tests = F.explode(F.sequence(F.greatest(F.lit(1), F.col("part")), last))
    rows = own.withColumn("test", tests)
    rows = rows.withColumns({"role": F.when(F.col("part") == F.col("test"), "test").otherwise("train"), "i": F.row_number().over(W.partitionBy("symbol", "test").orderBy("date")).cast("long")})
    return BT.forecasts(rows, ["symbol", "test"], ["gk_vol", *V.HAR], how, keep=("date", "slice", "part", "n_dev", "base"))


@query()
def research_sweep(spark, sf_dir):
    """Seven linear volatility models by two horizons and two numbers of folds for every symbol, with metrics and the gate. Runs with fewer than 60
    rows to train and test are skipped; linear models of one horizon and number of folds share their sums."""
    _, out = V.swept(kept(vol_rows(spark, sf_dir)), (5, 10), (5, 10), VOL_MODELS, keep=kept)
    name = F.split("symbol", "\\|")
    got = E.skill_gate(V.scores(out).withColumn("n_folds", name[2].cast("int"))).where("n_obs >= 60")
    return got.select(
        name[0].alias("symbol"), name[3].alias("model"), name[1].cast("int").alias("horizon"), name[2].cast("int").alias("n_splits"), F.col("n_obs").cast("long").alias("n_obs"), "folds_passed",
        *(r(m, 6).alias(m) for m in ("oos_r2", "qlike_skill_ratio", "holdout_oos_r2", "holdout_qlike_skill_ratio")), "cleared",
    )


@query()
def holdout_readout(spark, sf_dir):
    """The locked holdout's own metrics, whose targets are made inside it, of the log-space model."""
    got = V.scores(V.forecasts(V.sliced(vol_rows(spark, sf_dir))))
    return got.where("holdout_n_obs > 0").select("symbol", "holdout_n_obs", *(r(m, 6).alias(m) for m in METRICS if m.startswith("holdout")))


@query()
def har_coefficients(spark, sf_dir):
    """The log-space cascade's coefficients in every expanding fold and before the holdout."""
    own = V.parted(V.sliced(vol_rows(spark, sf_dir)))
    c = F.col("coefficients")
    return V.fitted(own, ["symbol"]).select("symbol", "part", "n", *(r(c[k], 6).alias(n) for k, n in enumerate(("intercept", "day", "week", "month"))))


# --- forecasts that drive weights ---------------------------------------------------------------------

MU_HORIZON = 20


def mu_forecasts(spark, sf_dir):
    """Boosted forecasts of the next 20 rows of every symbol: 252 rows of training, 252 of test, rolling."""
    return BT.walk_forward(featured(spark, sf_dir), {MU_HORIZON: f"y{MU_HORIZON}"}, DEFAULT)


def ml_window(spark, sf_dir):
    """Returns of all symbols on one calendar, their trailing windows, and each rebalance's expected daily returns."""
    returns = universe(spark, sf_dir)
    window = trailing(spark, sf_dir, returns)
    panel = mu_forecasts(spark, sf_dir).select("symbol", "date", (F.col("pred") / MU_HORIZON).alias("mu"))
    return returns, window, P.blended(window, P.known_at(window, panel))


@query()
def ml_mu_panel(spark, sf_dir):
    """The forecast panel: every symbol and date with the expected daily return of the next 20 rows."""
    return mu_forecasts(spark, sf_dir).select("symbol", d().alias("date"), r(F.col("pred") / MU_HORIZON).alias("mu"))


@query()
def weights_max_sharpe_ml(spark, sf_dir):
    """Maximum Sharpe ratio with the forecasts known at each rebalance as expected returns, where all symbols have one, else the window's means."""
    _, window, mu = ml_window(spark, sf_dir)
    return P.solved_weights(window, "max_sharpe", mu).select(d("rebalance").alias("rebalance"), "symbol", r("weight", 6).alias("weight"))


@query()
def ml_portfolio_returns(spark, sf_dir):
    """The backtest of these weights: net return of each date."""
    returns, window, mu = ml_window(spark, sf_dir)
    got = P.backtest(returns, P.solved_weights(window, "max_sharpe", mu))
    return got.groupBy(d().alias("date")).agg(r(F.first("net_return")).alias("net_return"))


def gate(spark, sf_dir):
    return P.gate_weights(mu_forecasts(spark, sf_dir), trailing(spark, sf_dir).select("rebalance"), MU_HORIZON)


@query()
def ml_gate_series(spark, sf_dir):
    """The skill of the forecasts known at each rebalance against the mean of their training rows, and the weight that they earn."""
    return gate(spark, sf_dir).select(F.lit("long").alias("window_id"), d("rebalance").alias("date"), "n", r("forecast_skill", 6).alias("forecast_skill"), r("forecast_weight", 6).alias("forecast_weight"))


@query()
def ml_gate_mean_weight(spark, sf_dir):
    return gate(spark, sf_dir).groupBy(F.lit("long").alias("window_id")).agg(r(F.avg("forecast_weight"), 6).alias("mean_weight"), F.count(F.lit(1)).alias("n"))


# --- robustness ----------------------------------------------------------------------------------

#: Probes around the base, declared before any run: a training length 100 shorter and longer, the horizon above, expanding windows.
BASE = {"train": 250, "horizon": 1, "window": "rolling"}
PROBES = {"train_size": [{"train": 150}, {"train": 350}], "horizon": [{"horizon": 2}], "window": [{"window": "expanding"}]}
VOL_BASE = {"horizon": 5, "least": 60, "folds": 5}
VOL_PROBES = {"horizon": [{"horizon": 3}, {"horizon": 7}], "min_periods": [{"least": 40}, {"least": 80}], "window": [{"folds": 3}, {"folds": 7}]}


def runs(base: dict, probes: dict[str, list[dict]]) -> list[tuple[str, str, dict]]:
    """(dimension, probe, configuration): the base, then one knob changed at a time; probes equal to the base are left out."""
    out = [("base", "base", base)]
    for dimension, changes in probes.items():
        out += [(dimension, ",".join(f"{k}={v}" for k, v in c.items()), base | c) for c in changes if base | c != base]
    return out


@query("select symbol, dimension, probe from (select distinct symbol from prices) s, (values ('base', 'base'), ('train_size', 'train=150'), ('train_size', 'train=350'), ('horizon', 'horizon=2'), ('window', 'window=expanding')) v(dimension, probe)", ("prices",))
def perturbation_grid(spark, sf_dir):
    """Every run of the return model's analysis for every symbol."""
    each = F.array(*(F.struct(F.lit(a).alias("dimension"), F.lit(b).alias("probe")) for a, b, _ in runs(BASE, PROBES)))
    return daily(spark, sf_dir).select("symbol").distinct().select("symbol", F.inline(each))


def return_runs(spark, sf_dir):
    """Metrics and the gate's outcome of every run of the ridge forecast: symbol, dimension, probe, metric, value, cleared."""
    names = ["l1", "l2", "m20"]
    w = X.by("symbol")
    rows = rows_of(spark, sf_dir).withColumns({f"y{h}": ahead("daily_return", h) for h in (1, 2)} | {"l1": F.col("daily_return"), "l2": F.lag("daily_return").over(w), "m20": F.avg("daily_return").over(X.last_n(w, 20))})
    every = runs(BASE, PROBES)
    grid = E.grid_forecasts(rows, {1: "y1", 2: "y2"}, {"all": names}, sorted({c["train"] for *_, c in every}), [1.0], windows=("rolling", "expanding"))
    keys = ["symbol", "horizon", "train", "window"]
    got = E.evaluated(grid.withColumn("vol", F.lit(None).cast("double")), keys).join(E.fold_counts(grid.withColumn("n_train", F.col("train")), keys), keys).withColumnRenamed("n", "n_obs")
    got = E.return_gate(got)
    each = F.array(*(F.struct(F.lit(a).alias("dimension"), F.lit(b).alias("probe"), F.lit(c["horizon"]).alias("horizon"), F.lit(c["train"]).alias("train"), F.lit(c["window"]).alias("window")) for a, b, c in every))
    # a configuration is one row of a literal table
    wanted = spark.range(1).select(F.inline(each))
    long = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("r2", "ic", "direction_accuracy"))))
    return got.join(F.broadcast(wanted), ["horizon", "train", "window"]).select("symbol", "dimension", "probe", "cleared", long)


def vol_runs(spark, sf_dir):
    """The same of the volatility model: every run's rows have a key of their own, so all runs are one pass."""
    rows, own = kept(vol_rows(spark, sf_dir)), None
    every = runs(VOL_BASE, VOL_PROBES)
    for dimension, probe, how in every:
        one = V.parted(V.sliced(rows, least=how["least"], horizon=how["horizon"]), how["folds"])
        one = one.withColumn("symbol", F.concat_ws("|", "symbol", F.lit(dimension), F.lit(probe), F.lit(str(how["folds"]))))
        own = one if own is None else own.unionByName(one)
    name = F.split("symbol", "\\|")
    got = E.skill_gate(V.scores(V.parted_forecasts(kept(V.with_base(own)))).withColumn("n_folds", name[3].cast("int")))
    long = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("oos_r2", "qlike_skill_ratio", "folds_passed"))))
    return got.select(name[0].alias("symbol"), name[1].alias("dimension"), name[2].alias("probe"), "cleared", long)


def reported(runs_):
    got = E.fragility(runs_, ["symbol"])
    return got.select("symbol", "dimension", "metric", r("base", 5).alias("base"), "n_probes", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"), r("swing", 5).alias("swing"), F.array_join("flags", ",").alias("flags"), "verdict")


@query()
def robustness_runs(spark, sf_dir):
    """The return model around its base: metrics and gate of every probe against the base run, by dimension."""
    return reported(return_runs(spark, sf_dir))


@query()
def vol_robustness(spark, sf_dir):
    """The volatility model around its base."""
    return reported(vol_runs(spark, sf_dir))
