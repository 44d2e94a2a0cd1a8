"""Boosted trees, nested tuning, importances, p-values, gates, windows of panels and streams against direct computations."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars
from tidewheel.operators import boosting as BT
from tidewheel.operators import evaluation as E
from tidewheel.operators import portfolio as P
from tidewheel.operators import series
from tidewheel.streaming import live


def naive_boost(x, y, how):
    """Trees grown node by node with plain loops; returns a function that predicts."""
    used = [k for k in range(x.shape[1]) if len(np.unique(x[~np.isnan(x[:, k]), k])) > 1]
    cuts = {}
    for k in used:
        v = x[~np.isnan(x[:, k]), k]
        own = np.unique(v)
        cuts[k] = (own[:-1] + own[1:]) / 2 if len(own) <= how.bins else np.unique(np.percentile(v, np.linspace(0, 100, how.bins + 1)[1:-1], method="midpoint"))

    def grow(rows, g, depth):
        total, n = g[rows].sum(), len(rows)
        best, choice = 1e-9, None
        if depth < how.depth:
            for k in used:
                v = x[rows, k]
                missing = np.isnan(v)
                for missing_left in [False, True] if missing.any() else [False]:
                    for cut in [*cuts[k], np.inf]:
                        left = np.where(missing, missing_left, v <= cut)
                        nl = left.sum()
                        if nl < how.least or n - nl < how.least:
                            continue
                        gl = g[rows][left].sum()
                        gain = gl**2 / (nl + how.l2) + (total - gl) ** 2 / (n - nl + how.l2) - total**2 / (n + how.l2)
                        if gain > best * (1 + 1e-9):
                            best, choice = gain, (k, cut, missing_left, left)
        if choice is None:
            return -how.rate * total / (n + how.l2)
        k, cut, missing_left, left = choice
        return k, cut, missing_left, grow(rows[left], g, depth + 1), grow(rows[~left], g, depth + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            k, cut, missing_left, a, b = tree
            tree = a if (missing_left if np.isnan(row[k]) else row[k] <= cut) else b
        return tree

    pred, trees = np.full(len(y), y.mean()), []
    for _ in range(how.rounds):
        trees.append(grow(np.arange(len(y)), pred - y, 0))
        pred = pred + np.array([value(trees[-1], r) for r in x])
    return lambda z: y.mean() + np.array([sum(value(t, r) for t in trees) for r in z])


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_boosting_equals_plain_loops(missing):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    x[:, 2] = rng.integers(0, 4, 120)
    x[:, 3] = 7.0
    y = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2] + rng.normal(size=120) * 0.3
    x[rng.random(x.shape) < missing] = np.nan
    how = BT.Boost(rounds=12, depth=3, least=8, l2=0.5, bins=16)
    got, want = BT.Model(x, y, how), naive_boost(x, y, how)
    z = np.vstack([x, rng.normal(size=(30, 4)), np.full((1, 4), np.nan)])
    assert np.allclose(got.predict(z), want(z), atol=1e-9)
    assert np.allclose(got.steps(x)[how.rounds], got.predict(x))


@pytest.fixture(scope="module")
def frame(spark):
    """Two symbols of 220 and 150 rows with a target that a feature tells in part."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 220), ("b", 150)):
        x = rng.normal(size=(n, 3))
        y = 0.8 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=n) * 0.5
        rows += [(s, date(2000, 1, 1) + timedelta(days=i), *map(float, x[i]), float(y[i]), float(abs(x[i, 2]))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, x0 double, x1 double, x2 double, y1 double, vol double").repartition(3).cache()


X = ["x0", "x1", "x2"]


def test_walk_forward_with_overlapping_windows(frame):
    """All folds in one job equal single fits; every row is forecast by the windows that hold it."""
    how = BT.Boost(rounds=8, depth=2)
    out = BT.walk_forward(frame, {1: "y1"}, X, train=80, test=40, step=20, how=how).toPandas()
    pdf = frame.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for s, own in pdf.groupby("symbol"):
        own = own.reset_index(drop=True)  # noqa: PLW2901
        n, folds = len(own), math.ceil((len(own) - 80) / 20)
        got = out[out.symbol == s]
        assert got.fold.nunique() == folds
        for k in range(folds):
            train, test = own.iloc[20 * k : 20 * k + 80], own.iloc[20 * k + 80 : min(20 * k + 120, n)]
            want = BT.Model(train[X].to_numpy(), train.y1.to_numpy(), how).predict(test[X].to_numpy())
            have = got[got.fold == k].sort_values("i")
            assert np.allclose(have.pred, want) and (have.i.to_numpy() == test.index.to_numpy()).all() and (have.n_train == 80).all()


def test_combined_windows(spark):
    rows = [("a", date(2000, 1, 1), 5, 1.0, p) for p in (1.0, 2.0, 6.0)] + [("a", date(2000, 1, 2), 6, 2.0, 4.0)]
    got = {r["i"]: (r["mean"], r["median"], r["n_windows"]) for r in BT.combined(spark.createDataFrame(rows, "symbol string, date date, i long, y double, pred double"), ["symbol"]).collect()}
    assert got == {5: (3.0, 2.0, 3), 6: (4.0, 4.0, 1)}


def test_groups_that_cannot_be_fitted_are_left_out(spark):
    rows = [("few", i, float(i), float(i % 7), "train") for i in range(30)] + [("few", 30, 1.0, 1.0, "test")]
    rows += [("flat", i, 1.0, float(i % 7), "train") for i in range(80)] + [("flat", 80, 1.0, 1.0, "test")]
    rows += [("good", i, float(i % 11), float(i % 7), "train") for i in range(80)] + [("good", 80, None, None, "test")]
    df = spark.createDataFrame(rows, "symbol string, i long, x double, y double, role string").withColumn("z", F.when(F.col("symbol") == "good", F.col("x") * F.col("x")))
    got = BT.forecasts(df, ["symbol"], ["x", "z"], BT.Boost(rounds=3), keep=()).collect()
    assert [r["symbol"] for r in got] == ["good"] and got[0]["n_train"] == 80


def test_nested_ridge_never_sees_the_outer_fold(frame):
    """The chosen penalty and coefficients equal a direct search over three expanding folds inside each training part."""
    rows = E.numbered(frame.withColumnRenamed("y1", "y"))
    folds = E.folds(rows, 90, 40, 2)
    got = E.nested_ridge(rows, folds, X, "y").toPandas()
    pdf = rows.toPandas().sort_values(["symbol", "i"])

    def fit(part, penalty):
        a = np.column_stack([np.ones(len(part)), part[X]])
        return np.linalg.solve(a.T @ a + penalty * np.diag([0.0, 1, 1, 1]), a.T @ part.y)

    assert len(got) == 6
    for g in got.itertuples():
        own = pdf[(pdf.symbol == g.symbol) & (pdf.i >= 40 * g.fold) & (pdf.i < 40 * g.fold + 90)]
        losses = {}
        for penalty in E.PENALTIES:
            errors = []
            for to, end in BT.inner_splits(90):
                beta, test = fit(own.iloc[:to], penalty), own.iloc[to:end]
                errors.append(((test.y - np.column_stack([np.ones(len(test)), test[X]]) @ beta) ** 2).mean())
            losses[penalty] = np.mean(errors)
        assert g.ridge == min(losses, key=losses.get) and abs(g.inner_mse - min(losses.values())) < 1e-9
        assert np.allclose(g.coefficients, fit(own, g.ridge))


def test_tuned_takes_the_grid_point_with_the_least_inner_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 2))
    y = np.sin(3 * x[:, 0]) + rng.normal(size=100) * 0.2
    got = BT.tuned(x, y, BT.Boost())

    def loss(how):
        return sum(((BT.Model(x[:to], y[:to], how).predict(x[to:end]) - y[to:end]) ** 2).mean() for to, end in BT.inner_splits(100))

    others = [BT.Boost(r, d, rate, 20, l2) for rate in BT.GRID["rate"] for d in BT.GRID["depth"] for l2 in BT.GRID["l2"] for r in BT.GRID["rounds"]]
    assert math.isclose(loss(got), min(map(loss, others)), rel_tol=1e-9)
    assert BT.tuned(x[:50], y[:50], BT.Boost(rounds=9)) == BT.Boost(rounds=9)


def test_permutation_importance(frame):
    """What tells the target matters most, noise does not; a rerun and another partitioning give the same."""
    rows = E.numbered(frame).withColumn("y", F.col("y1"))
    got = {(r["symbol"], r["feature"]): r["importance"] for r in BT.importances(rows, ["symbol"], X, BT.Boost(rounds=30)).collect()}
    again = {(r["symbol"], r["feature"]): r["importance"] for r in BT.importances(rows.repartition(7), ["symbol"], X, BT.Boost(rounds=30)).collect()}
    assert got == again and len(got) == 6
    for s in "ab":
        assert got[s, "x0"] > got[s, "x1"] > got[s, "x2"]


def test_partners_are_permutations(frame):
    got = BT.with_partners(E.numbered(frame), ["symbol"]).toPandas()
    for _, own in got.groupby("symbol"):
        for k in range(3):
            assert sorted(own[f"partner{k}"]) == list(range(len(own)))
        assert (own.partner0 != own.partner1).any()


def test_latest_is_shrunk_and_bounded(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(140, 2))
    rows = [("a", date(2000, 1, 1) + timedelta(days=i), 0.001 * float(x[i, 1]), float(x[i, 0]), float(x[i, 1]), None if i == 139 else float(3 * x[i, 0])) for i in range(140)]
    df = spark.createDataFrame(rows, "symbol string, date date, daily_return double, x0 double, x1 double, y double")
    r = BT.latest(df, ["x0", "x1"], train=100, how=BT.Boost(rounds=5), tune=False).first()
    want = BT.Model(x[39:139], 3 * x[39:139, 0], BT.Boost(rounds=5)).predict(x[139:])[0]
    assert math.isclose(r["raw"], want) and r["bound"] == 0.05 and r["date"] == date(2000, 5, 19)
    assert math.isclose(r["calibrated"], max(-0.05, min(0.05, 0.5 * want + 0.5 * (3 * x[39:139, 0]).mean())))


NODES = np.polynomial.legendre.leggauss(300)


def exact_p(r, n):
    """Closed forms of the tail for few pairs, Gauss-Legendre elsewhere."""
    r = abs(r)
    if n == 3:
        return 2 * math.acos(r) / math.pi
    if n == 4:
        return 1 - r
    at, w = NODES  # of powers of the cosine, which are smooth up to the end
    tail = lambda lo: (math.pi / 2 - lo) / 2 * (w * np.cos((math.pi / 2 - lo) / 2 * at + (math.pi / 2 + lo) / 2) ** (n - 3)).sum()
    return tail(math.asin(r)) / tail(0.0)


def test_p_values(spark):
    rows = [(r, n) for n in (3, 4, 5, 6, 12, 50, 300, 2500) for r in (0.0, 1e-6, 0.03, -0.2, 0.5, -0.9)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", scalars.correlation_p("r", "n").alias("p")).collect()
    for g in got:
        assert abs(g["p"] - exact_p(g["r"], g["n"])) < 1e-9, g
    odd = spark.createDataFrame([(None, 10), (float("nan"), 10), (1.0, 10), (0.4, 2)], "r double, n long").select(scalars.correlation_p("r", "n").alias("p")).collect()
    assert [g["p"] for g in odd] == [1.0, 1.0, 0.0, 1.0]


def test_ln_gamma(spark):
    got = spark.createDataFrame([(float(z),) for z in (0.5, 1, 1.5, 7, 300.25, 1e6)], "z double").select("z", scalars.ln_gamma(F.col("z")).alias("v")).collect()
    assert all(abs(g["v"] - math.lgamma(g["z"])) <= 1e-12 * max(1, abs(g["v"])) for g in got)


def test_gates_close_on_nan(spark):
    """NaN, an infinity or null in any metric of either gate keeps it shut."""
    good = {"r2": 0.1, "direction_accuracy": 0.6, "folds_passed": 5.0, "n_folds": 5.0, "n_obs": 300.0, "annualised_alpha": 0.1, "turnover_adjusted_sharpe": 1.0}
    skill = {"oos_r2": 0.3, "qlike_skill_ratio": 0.8, "folds_passed": 5.0, "n_folds": 5.0, "n_obs": 300.0}
    for gate, metrics in ((E.return_gate, good), (E.skill_gate, skill)):
        rows = [metrics] + [metrics | {k: v} for k in metrics for v in (float("nan"), float("inf"), None)]
        df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{k} double" for k in metrics))
        cleared = [r["id"] for r in gate(df).where("cleared").collect()]
        assert cleared == [0]
        named = gate(df).where("id = 1").first()["reasons"]
        assert any(next(iter(metrics)) in x for x in named)


def test_evaluated_against_numpy(spark):
    rng = np.random.default_rng(8)
    y, pred, vol = rng.normal(size=(3, 90))
    df = spark.createDataFrame([("a", 5, date(2000, 1, 1) + timedelta(days=i), float(y[i]), float(pred[i]), float(vol[i])) for i in range(90)], "symbol string, horizon int, date date, y double, pred double, vol double")
    r = E.evaluated(df.repartition(4), ["symbol", "horizon"]).first()
    s = (np.sign(pred) * y)[::5]
    ic = np.corrcoef(y, pred)[0, 1]
    sharpe = s.mean() / s.std() * math.sqrt(252 / 5)
    hit = (np.sign(pred) == np.sign(y)).astype(float)
    q1, q2 = np.quantile(vol, [1 / 3, 2 / 3])
    want = {
        "n": 90, "ic": ic, "ic_pvalue": exact_p(ic, 90), "direction_accuracy": hit.mean(), "baseline_direction_accuracy": max((y > 0).mean(), (y < 0).mean()), "sharpe": sharpe, "annualised_alpha": s.mean() * 252 / 5,
        "r2": math.copysign(ic * ic, ic), "turnover_adjusted_sharpe": sharpe - 0.0005 * np.abs(np.diff(pred)).mean(), "direction_accuracy_low": hit[vol <= q1].mean(), "direction_accuracy_high": hit[vol > q2].mean(),
    }
    assert all(math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-9) for k, v in want.items())
    flat = E.evaluated(df.withColumn("pred", F.lit(1.0)), ["symbol", "horizon"]).first()
    assert (flat["ic"], flat["ic_pvalue"], flat["r2"]) == (0.0, 1.0, 0.0)


def test_expanding_grid_equals_direct_fits(frame):
    rows = E.numbered(frame)
    out = E.grid_forecasts(rows, {1: "y1"}, {"all": X}, [60], [0.5], test=30, windows=("rolling", "expanding")).toPandas()
    pdf = rows.toPandas().sort_values(["symbol", "i"])
    own = pdf[pdf.symbol == "a"].reset_index(drop=True)
    for window in ("rolling", "expanding"):
        for k in range(5):
            train, test = own.iloc[0 if window == "expanding" else 30 * k : 30 * k + 60], own.iloc[30 * k + 61 : 30 * k + 91]
            a = np.column_stack([np.ones(len(train)), train[X]])
            beta = np.linalg.solve(a.T @ a + 0.5 * np.diag([0.0, 1, 1, 1]), a.T @ train.y1)
            have = out[(out.symbol == "a") & (out.window == window) & (out.fold == k)].sort_values("date")
            assert np.allclose(have.pred, np.column_stack([np.ones(len(test)), test[X]]) @ beta)


def test_fragility(spark):
    runs = [
        ("a", "base", "b", "ic", 0.10, True), ("a", "train", "p", "ic", 0.12, True), ("a", "train", "q", "ic", 0.08, True), ("a", "horizon", "p", "ic", -0.01, True), ("a", "window", "p", "ic", 0.3, True),
        ("a", "seed", "p", "ic", 0.1, False), ("a", "empty", "p", "ic", None, None), ("a", "other", "p", "r2", 0.1, True),
    ]
    got = E.fragility(spark.createDataFrame(runs, "symbol string, dimension string, probe string, metric string, value double, cleared boolean"), ["symbol"]).collect()
    by = {r["dimension"]: (set(r["flags"]), r["verdict"]) for r in got}
    assert by["train"] == (set(), "robust") and by["horizon"] == ({"sign_flip", "large_swing"}, "fragile") and by["window"] == ({"large_swing"}, "fragile")
    assert by["seed"] == ({"gate_flip"}, "fragile") and by["empty"] == ({"no_probes"}, "inconclusive") and by["other"] == ({"no_base"}, "inconclusive")


# --- panels --------------------------------------------------------------------------------------


def day(k):
    return date(2001, 1, 1) + timedelta(days=k)


def test_calendar_align_of_many_keys(spark):
    rng = random.Random(6)
    spine = [day(k) for k in range(60) if k % 7 < 5]
    rows, want = [], {}
    for s in "abcd":
        own = {day(k): None if rng.random() < 0.1 else rng.uniform(-0.1, 0.1) for k in range(3 if s == "d" else 0, 60) if rng.random() < 0.8}
        rows += [(s, k, v) for k, v in own.items()]
        wealth, values = None, []
        steps = sorted(own.items())
        for x in spine:
            while steps and steps[0][0] <= x:
                wealth = (1.0 if wealth is None else wealth) * (1 + (steps.pop(0)[1] or 0.0))
            values.append(wealth)
        want[s] = [None] + [None if a is None or b is None else b / a - 1 for a, b in zip(values, values[1:], strict=False)]
    df = spark.createDataFrame(rows, "symbol string, date date, daily_return double")
    got = P.calendar_align(df, spark.createDataFrame([(x,) for x in spine], "date date")).orderBy("date").collect()
    for s in "abcd":
        own = [r["daily_return"] for r in got if r["symbol"] == s]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(own, want[s], strict=True))


def test_window_panel_rules(spark):
    rows = [("a", day(k), 0.01) for k in range(10)] + [("b", day(k), 0.02) for k in range(4, 10)] + [("z", day(k), 0.5) for k in (3, 6, 7)]
    df = spark.createDataFrame(rows, "symbol string, date date, daily_return double")
    panel = lambda rule, floor=None: sorted((r["symbol"], r["date"]) for r in P.window_panel(df, rule, "z", floor).collect())
    floor = F.lit(day(6))
    assert panel("without") == [("a", day(k)) for k in range(4, 10)] + [("b", day(k)) for k in range(4, 10)]
    assert panel("floor", floor) == [(s, day(k)) for s in "ab" for k in range(6, 10)]
    assert panel("with", floor) == panel("floor", floor) + [("z", day(k)) for k in range(7, 10)]
    assert panel("floor") == panel("other", floor) == sorted((s, x) for s, x, _ in rows if s != "z")


def test_forecasts_are_known_at_the_rebalance(spark):
    """The last forecast on or before a rebalance counts, none after; a rebalance on which one is missing takes the means."""
    window = spark.createDataFrame([(day(r), s, day(r - k), 0.01 * (i + 1)) for r in (10, 20) for i, s in enumerate("ab") for k in range(1, 4)], "rebalance date, symbol string, date date, daily_return double")
    panel = spark.createDataFrame([("a", day(9), 0.5), ("a", day(10), 0.6), ("a", day(11), 0.7), ("b", day(15), 0.9), ("b", day(21), 9.0)], "symbol string, date date, mu double")
    got = {(r["rebalance"], r["symbol"]): r["mu"] for r in P.blended(window, P.known_at(window, panel)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(day(10), "a"): 0.01, (day(10), "b"): 0.02, (day(20), "a"): 0.7, (day(20), "b"): 0.9}
    half = P.blended(window, P.known_at(window, panel), spark.createDataFrame([(day(20), 0.5)], "rebalance date, forecast_weight double"))
    assert {(r["symbol"], round(r["mu"], 9)) for r in half.where(F.col("rebalance") == day(20)).collect()} == {("a", 0.355), ("b", 0.46)}


def test_max_sharpe_follows_given_means(spark):
    rng = np.random.default_rng(4)
    window = spark.createDataFrame([(day(100), s, day(k), float(v)) for s, own in zip("abc", rng.normal(0, 0.01, (3, 60)), strict=True) for k, v in enumerate(own)], "rebalance date, symbol string, date date, daily_return double")
    for best in "abc":
        mu = spark.createDataFrame([(day(100), s, 0.01 if s == best else 0.0001) for s in "abc"], "rebalance date, symbol string, mu double")
        w = {r["symbol"]: r["weight"] for r in P.solved_weights(window, "max_sharpe", mu).collect()}
        assert math.isclose(sum(w.values()), 1) and max(w, key=w.get) == best and w[best] <= 0.4 + 1e-9


def test_gate_weights_use_what_is_known(spark):
    """A forecast counts once its target, two rows later, is known."""
    rows = [("a", day(k), float(k % 3), float(k % 3) + 0.1, 1.0) for k in range(12)]
    f = spark.createDataFrame(rows, "symbol string, date date, y double, pred double, train_mean double")
    at = spark.createDataFrame([(day(x),) for x in (1, 5, 11)], "rebalance date")
    got = {r["rebalance"]: r for r in P.gate_weights(f, at, 2, least=4).collect()}
    assert [got[day(x)]["n"] for x in (1, 5, 11)] == [0, 4, 10]
    base = sum((k % 3 - 1) ** 2 for k in range(4))
    assert math.isclose(got[day(5)]["forecast_weight"], 1 - 4 * 0.01 / base) and got[day(1)]["forecast_weight"] == 0.0


def test_thinned_boundaries(spark):
    rng = random.Random(11)
    rows = [(s, day(rng.randrange(2000)), i) for s in "ab" for i in range(60)] + [("c", day(5), 0)]
    df = spark.createDataFrame(rows, "symbol string, date date, n int")
    got = sorted((r["symbol"], r["date"]) for r in series.thinned(df, ["symbol"], 90).collect())
    want = []
    for s in "abc":
        last = None
        for x in sorted({x for k, x, _ in rows if k == s}):
            if last is None or (x - last).days >= 90:
                want.append((s, x))
                last = x
    assert got == want
    assert series.thinned(df, ["symbol"], 0).count() == len(rows)


# --- streams -------------------------------------------------------------------------------------

TICK = "symbol string, ts timestamp, v double, seq long"


def test_live_bars_over_restarts(spark, tmp_path):
    """A later tick of an open day supersedes whenever it comes, a closed day is never published again, and a stream without news changes nothing."""
    at = lambda d, h: datetime(2024, 1, d, h)
    deliveries = [
        [("a", at(1, 9), 1.0, 1), ("a", at(1, 15), 5.0, 2), ("b", at(1, 10), 7.0, 3), ("a", None, 9.0, 4)],
        [("a", at(1, 18), 3.0, 5), ("a", at(2, 9), 2.0, 6), ("b", at(1, 9), 8.0, 7)],  # day 1 is still open: its close changes
        [("a", at(6, 9), 4.0, 8)],  # closes days 1 and 2
        [("a", at(2, 23), 100.0, 9), ("b", at(9, 9), 1.0, 10)],  # too late for day 2; closes day 6
    ]
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    for d in deliveries:
        spark.createDataFrame(d, TICK).coalesce(1).write.mode("append").parquet(source)
        got = live.publish(spark, source, TICK, sink, state, ["symbol"], "ts", "v", "seq")
        seen.append(sorted((r["symbol"], r["day"].day, r["open"], r["high"], r["low"], r["close"], r["n"]) for r in got.collect()))
    assert seen[0] == seen[1] == []
    first = [("a", 1, 1.0, 5.0, 1.0, 3.0, 3), ("a", 2, 2.0, 2.0, 2.0, 2.0, 1), ("b", 1, 8.0, 8.0, 7.0, 7.0, 2)]
    assert seen[2] == first and seen[3] == sorted([*first, ("a", 6, 4.0, 4.0, 4.0, 4.0, 1)])
    again = live.publish(spark, source, TICK, sink, state, ["symbol"], "ts", "v", "seq")
    assert again.count() == 4
    whole = live.live_bars(spark.createDataFrame([r for d in deliveries[:3] for r in d], TICK), ["symbol"], "ts", "v", "seq").collect()
    assert len(whole) == 4


