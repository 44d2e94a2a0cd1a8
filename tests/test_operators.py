"""Golden values and properties of the series and portfolio operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.functions import windows as X
from tidewheel.operators import contracts, evaluation, performance, portfolio, series
from tidewheel.sources import landing

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_normal_cdf_error(spark):
    got = spark.range(-40, 41).select((F.col("id") / 10).alias("x")).select("x", S.normal_cdf("x").alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-6 for r in got)


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, t int, v double")
    new = spark.createDataFrame([("a", 1, 9.0)], old.schema)
    once = landing.upsert(old, new, ["k", "t"])
    twice = landing.upsert(once, new, ["k", "t"])
    assert sorted(map(tuple, twice.collect())) == [("a", 1, 9.0), ("b", 1, 2.0)]


def test_asof_matches_equal_times_and_earlier_years(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 1),), (dt.date(2020, 1, 1),)], "date date")
    right = spark.createDataFrame([(dt.date(2021, 6, 1), 1.0), (dt.date(2024, 1, 2), 2.0), (dt.date(2024, 1, 3), None)], "date date, v double")
    got = {r["date"]: r["x"] for r in series.asof_multi(left, right, {"x": F.col("v")}).collect()}
    assert got == {dt.date(2024, 1, 2): 2.0, dt.date(2024, 1, 1): 1.0, dt.date(2020, 1, 1): None}


@pytest.mark.parametrize("n", [3, 4, 5, 8, 50])
def test_quantile_labels_equal_pandas(spark, n):
    vol = np.random.default_rng(n).permutation(n) / 7
    pdf = pd.DataFrame({"symbol": "s", "date": [DAY(k) for k in range(n)], "vol_20d": vol})
    got = series.quantile_labels(spark.createDataFrame(pdf)).orderBy("date").toPandas()["regime"].tolist()
    assert got == pd.qcut(pdf["vol_20d"].rank(method="first"), 3, labels=["Low", "Medium", "High"]).astype(str).tolist()


def test_few_rows_are_all_medium(spark):
    df = spark.createDataFrame([("s", DAY(0), 0.1), ("s", DAY(1), 0.2)], "symbol string, date date, vol_20d double")
    assert {r["regime"] for r in series.quantile_labels(df).collect()} == {"Medium"}


def test_calendar_fold_over_a_weekend(spark):
    spine = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (4, 5, 8)], "date date")
    asset = spark.createDataFrame([(dt.date(2024, 1, d), 0.1) for d in (5, 6, 7, 8)], "date date, daily_return double").withColumn("symbol", F.lit("a"))
    got = [r["daily_return"] for r in portfolio.calendar_align(asset, spine).orderBy("date").collect()]
    assert got[0] is None and got[-1] == pytest.approx(0.331)


def test_backtest_equals_day_by_day(spark):
    rng = np.random.default_rng(1)
    days, names = [DAY(k) for k in range(60)], ["a", "b", "c"]
    ret = rng.normal(0, 0.02, (60, 3))
    rows = [(n, d, float(ret[i, j])) for i, d in enumerate(days) for j, n in enumerate(names)]
    x = spark.createDataFrame(rows, "symbol string, date date, daily_return double")
    targets = {days[9]: [0.2, 0.3, 0.5], days[29]: [0.6, 0.2, 0.2]}
    w = spark.createDataFrame([(d, n, v) for d, t in targets.items() for n, v in zip(names, t, strict=True)], "rebalance date, symbol string, weight double")
    got = {r["date"]: r["net_return"] for r in portfolio.backtest(x, w, 0.001).select("date", "net_return").distinct().collect()}
    held, pending = np.zeros(3), None
    for i, d in enumerate(days):
        cost = 0.0
        if pending is not None:
            cost, held, pending = 0.5 * np.abs(pending - held).sum() * 0.001, pending, None
        if held.sum():
            assert got[d] == pytest.approx(float(held @ ret[i]) - cost, abs=1e-12)
            held = held * (1 + ret[i]) / (held @ (1 + ret[i]))
        if d in targets:
            pending = np.array(targets[d])


def test_solved_weights(spark):
    rng = np.random.default_rng(2)
    s = np.cov((rng.normal(0, 1, (300, 3)) * [0.01, 0.02, 0.03] + 0.001).T)
    w = portfolio._risk_parity(s)
    rc = w * (s @ w)
    assert w.sum() == pytest.approx(1) and np.allclose(rc, rc.mean(), rtol=1e-6)
    m = portfolio._max_sharpe(s, np.array([0.001, 0.002, 0.001]))
    assert m.sum() == pytest.approx(1) and m.min() >= 0 and m.max() <= 0.4 + 1e-9


def test_tilt_cap_and_no_signal(spark):
    rows = [(DAY(0), n, mu, 0.01) for n, mu in (("a", 9.0), ("b", 1.0), ("c", 1.0), ("d", 0.0))] + [(DAY(1), n, -1.0, 0.01) for n in "abcd"]
    got = portfolio.tilt_weights(spark.createDataFrame(rows, "date date, symbol string, mu double, sigma double")).collect()
    first = {r["symbol"]: r["weight"] for r in got if r["date"] == DAY(0)}
    assert sum(first.values()) == pytest.approx(1) and first["a"] == pytest.approx(0.4) and first["d"] == 0
    assert all(r["weight"] == 0.25 for r in got if r["date"] == DAY(1))


@pytest.mark.parametrize(("values", "p"), [([1.0, 2.0, 3.0], 0.0), ([0.0, 0.0], 1.0), ([-1.0, -1.0, 1.0, 1.0], 1.0)])
def test_p_value(spark, values, p):
    assert spark.createDataFrame([(v,) for v in values], "x double").agg(portfolio.p_value(F.col("x"))).first()[0] == p


def test_sharpe_and_total_loss(spark):
    df = spark.createDataFrame([(0.1,), (-1.0,), (0.2,)], "r double")
    assert df.agg(performance.annual_return("r")).first()[0] == -1
    assert spark.createDataFrame([(0.01,), (0.01,)], "r double").agg(performance.sharpe("r")).first()[0] == 0.0


def test_zscore_of_constants_is_null(spark):
    df = spark.createDataFrame([("s", DAY(k), 1.0) for k in range(5)], "symbol string, date date, x double")
    assert {r[0] for r in df.select(X.zscore("x", X.last_n(X.by("symbol"), 3), 2)).collect()} == {None}


def test_ewma_equals_recursion(spark):
    x = np.random.default_rng(3).normal(0, 1, 1500)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "date": [DAY(k) for k in range(1500)], "x": x}))
    got = series.ewma(df, "symbol", "x").orderBy("date").toPandas()["ewma"].to_numpy()
    e = [x[0]]
    for v in x[1:]:
        e.append(0.94 * e[-1] + 0.06 * v)
    assert np.abs(got - e).max() < 1e-12


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 2.0), ("c", None, 2.0)], "k string, lo double, hi double")
    assert {r["k"] for r in contracts.interval_ordered(df).collect()} == {"b", "c"}


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 200)
    df = evaluation.numbered(spark.createDataFrame(pd.DataFrame({"symbol": "s", "date": [DAY(k) for k in range(200)], "a": x[:, 0], "b": x[:, 1], "y": y})))
    f = evaluation.folds(df, 150, 25)
    got = evaluation.least_squares(df, f, ["a", "b"], "y").where("fold = 0").first()["coefficients"]
    assert np.allclose(got, np.linalg.lstsq(np.c_[np.ones(150), x[:150]], y[:150], rcond=None)[0])


def reference_har(v, ridge=0.0, floor=0.002):
    """Expanding folds, log-space least squares with smearing, EWMA baseline and holdout of one series, by numpy."""
    v = np.asarray(v)
    har = np.stack([np.array([v[max(0, t - n) : t].mean() if t else np.nan for t in range(len(v))]) for n in (1, 5, 22)], 1)
    ok = ~np.isnan(har).any(axis=1)
    v, har = v[ok], har[ok]
    hold = min(252, int(0.2 * len(v)))
    dev = len(v) - hold
    slices = [slice(0, dev), slice(dev, len(v))]
    x, y, g = [], [], []
    for s in slices:
        own = v[s]
        n = len(own) - 5
        y.append(np.array([own[t + 1 : t + 6].mean() for t in range(n)]))
        x.append(np.log(np.maximum(har[s][:n], floor)))
        g.append(own[:n])
    level = []
    for value in np.concatenate(g):
        level.append(value if not level else 0.94 * level[-1] + 0.06 * value)
    level = np.array(level)

    def fit(xs, ys):
        a, b = np.column_stack([np.ones(len(xs)), xs]), np.log(np.maximum(ys, floor))
        beta = np.linalg.solve(a.T @ a + ridge * np.diag([0, 1, 1, 1]), a.T @ b)
        smear = np.exp(b - a @ beta).mean()
        return lambda q: np.exp(np.column_stack([np.ones(len(q)), q]) @ beta) * smear

    def loss(a, p):
        r = (np.maximum(p, floor) / np.maximum(a, floor)) ** 2
        return (r - np.log(r) - 1).mean()

    n, t = len(y[0]), len(y[0]) // 6
    preds, actual, base, passed = [], [], [], 0
    for k in range(5):
        lo, hi = n - (5 - k) * t, n - (4 - k) * t
        p = fit(x[0][:lo], y[0][:lo])(x[0][lo:hi])
        preds.append(p)
        actual.append(y[0][lo:hi])
        base.append(level[lo:hi])
        passed += loss(actual[-1], p) < loss(actual[-1], base[-1])
    a, p, b = map(np.concatenate, (actual, preds, base))
    h = fit(x[0], y[0])(x[1])
    r2 = lambda u, w: 1 - ((u - w) ** 2).sum() / ((u - u.mean()) ** 2).sum()
    return {"n_obs": n, "oos_r2": r2(a, p), "qlike": loss(a, p), "baseline_qlike": loss(a, b), "folds_passed": passed, "holdout_oos_r2": r2(y[1], h), "holdout_qlike": loss(y[1], h), "holdout_baseline_qlike": loss(y[1], level[n:])}


def test_vol_backtest_against_numpy(spark):
    import datetime

    from tidewheel.operators import volatility as V

    rng = np.random.default_rng(3)
    v = {s: np.exp(np.cumsum(rng.normal(0, 0.1, 400)) * 0.5 - 4.5) for s in ("a", "b")}
    rows = [(s, datetime.date(2000, 1, 1) + datetime.timedelta(t), float(x[t]), *(float(x[max(0, t - n) : t].mean()) if t else None for n in (1, 5, 22))) for s, x in v.items() for t in range(400)]
    df = spark.createDataFrame(rows, "symbol string, date date, gk_vol double, har_vol_1d double, har_vol_5d double, har_vol_22d double")
    for ridge in (0.0, 1.0):
        got = V.scores(V.forecasts(V.sliced(df), ridge=ridge)).toPandas().set_index("symbol")
        for s, x in v.items():
            for k, want in reference_har(x, ridge).items():
                assert got.loc[s, k] == pytest.approx(want, rel=1e-6), (s, k)
    assert V.next_forecast(df).count() == 2


@pytest.mark.parametrize("decay", [0.2, 0.94, 0.99, 0.999, 0.99999])
def test_ewma_for_every_decay(spark, decay):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 20, 3000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, date int, v double")
    got = series.ewma(df, "symbol", "v", decay).orderBy("date").toPandas().ewma.to_numpy()
    want = [x[0]]
    for v in x[1:]:
        want.append(decay * want[-1] + (1 - decay) * v)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_table_survives_restart_and_repeated_batches(spark, tmp_path):
    from tidewheel.streaming.incremental import ParquetTable

    make = lambda: ParquetTable(spark, str(tmp_path / "t"), "k int, v int", [F.col("v").desc()])
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v int")
    make().merge(batch((1, 5), (1, 7)), ["k"])
    t = make()  # a restart
    for _ in range(2):  # a repeated batch
        t.merge(batch((2, 1), (1, 6)), ["k"])
    (tmp_path / "t" / "v9").mkdir()  # what a failed merge left
    assert sorted(map(tuple, make().read().collect())) == [(1, 7), (2, 1)]
    assert len(make().versions()) == 2


def test_fixed_weights(spark):
    from tidewheel.operators import portfolio

    w = spark.createDataFrame([("2020-01-31", "a"), ("2020-01-31", "b"), ("2020-02-28", "a")], "rebalance string, symbol string")
    got = {(r["rebalance"], r["symbol"]): r["weight"] for r in portfolio.fixed_weights(w, {"a": 1.0}).collect()}
    assert got == {("2020-01-31", "a"): 1.0, ("2020-01-31", "b"): 0.0, ("2020-02-28", "a"): 1.0}
    for bad in ({"a": 0.5}, {}, {"a": float("nan"), "b": 1.0}):
        with pytest.raises(ValueError):
            portfolio.fixed_weights(w, bad)


def test_gate_fails_closed(spark):
    from tidewheel.operators import evaluation as E

    rows = [("good", 0.2, 0.5, 3.0, 5.0, 300.0), ("few", 0.2, 0.5, 2.0, 5.0, 300.0), ("odd", 1.5, 0.5, 6.0, 5.0, 300.0), ("none", None, 0.5, 3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "symbol string, oos_r2 double, qlike_skill_ratio double, folds_passed double, n_folds double, n_obs double")
    got = {r["symbol"]: (r["cleared"], r["reasons"]) for r in E.skill_gate(df).collect()}
    assert got == {"good": (True, []), "few": (False, ["folds_passed"]), "odd": (False, ["implausible oos_r2", "implausible folds_passed"]), "none": (False, ["missing n_obs", "missing oos_r2"])}


def test_grid_of_configurations_against_single_fits(spark):
    from tidewheel.operators import evaluation as E

    rng = np.random.default_rng(2)
    rows = [(s, DAY(t), t, float(rng.normal()), float(rng.normal()), float(rng.normal())) for s in ("a", "b") for t in range(260)]
    df = spark.createDataFrame(rows, "symbol string, date date, i long, x1 double, x2 double, y double")
    got = E.grid_forecasts(df, {2: "y"}, {"one": ["x1"], "both": ["x1", "x2"]}, [100, 150], [0.0, 5.0], test=40)
    assert got.select("train", "features", "ridge").distinct().count() == 8
    for train, features, ridge in ((100, ["x1"], 5.0), (150, ["x1", "x2"], 0.0)):
        f = E.folds(df, train, 40, 2)
        want = E.predicted(df, f, E.least_squares(df, f, features, "y", ridge=ridge), features).select("symbol", "date", "fold", F.col("pred").alias("want"))
        label = "one" if features == ["x1"] else "both"
        both = got.where((F.col("train") == train) & (F.col("features") == label) & (F.col("ridge") == ridge)).join(want, ["symbol", "date", "fold"], "full_outer").toPandas()
        assert len(both) == want.count() and np.allclose(both.pred, both.want)


def test_snapshot_is_published_whole_or_not_at_all(spark, tmp_path):
    path, rows = str(tmp_path / "public"), spark.range(5).toDF("v")
    landing.export_snapshot({"a": rows, "b": rows}, path)
    bad = rows.select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        landing.export_snapshot({"a": spark.range(9).toDF("v"), "b": bad}, path)
    with pytest.raises(ValueError, match="more than 10"):
        landing.export_snapshot({"a": spark.range(9).toDF("v")}, path, max_bytes=10)
    assert landing.snapshot_table(spark, path, "a").count() == 5
    assert [p.name for p in (tmp_path / "public").iterdir()] == ["snapshot-000000001"]
    for n in (6, 7, 8):
        landing.export_snapshot({"a": spark.range(n).toDF("v")}, path)
    assert sorted(p.name for p in (tmp_path / "public").iterdir()) == ["snapshot-000000003", "snapshot-000000004"]
    assert landing.snapshot_table(spark, path, "_manifest").collect()[0].asDict() == {"table": "a", "rows": 8}


def test_stored_tables_are_made_and_widened_once(spark, tmp_path):
    name, schema = "tidewheel_test_ensured", spark.createDataFrame([], "k string, V double, more long").schema
    spark.createDataFrame([("a", 1.0)], "k string, v double").write.option("path", str(tmp_path / "t")).format("parquet").saveAsTable(name)
    try:
        assert landing.ensure_tables(spark, {name: schema, f"{name}_new": schema}, str(tmp_path)) == {name: ["more"], f"{name}_new": ["k", "V", "more"]}
        assert landing.ensure_tables(spark, {name: schema, f"{name}_new": schema}, str(tmp_path)) == {name: [], f"{name}_new": []}
        assert [tuple(r) for r in spark.table(name).collect()] == [("a", 1.0, None)]
        assert spark.table(f"{name}_new").count() == 0
    finally:
        for n in (name, f"{name}_new"):
            spark.sql(f"drop table if exists {n}")


def test_metrics_table_sorts_and_fills(spark):
    rows = [("return_x", "a", "ic", 0.1), ("return_x", "b", "ic", 0.2), ("return_x", "c", "r2", 0.5), ("vol_x", "d", "ic", 0.9), ("return_x", "e", "ic", 0.2), ("return_x", "e", "direction_accuracy", 0.6)]
    got = evaluation.metrics_table(spark.createDataFrame(rows, "model string, symbol string, metric string, value double"), ("ic", "direction_accuracy", "r2"))
    assert [tuple(r) for r in got.collect()] == [("e", 0.2, 0.6, None), ("b", 0.2, None, None), ("a", 0.1, None, None), ("c", None, None, 0.5)]
