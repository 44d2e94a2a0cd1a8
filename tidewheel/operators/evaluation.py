"""Walk-forward evaluation: folds, per-fold least squares by Gram sums, gates, robustness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as X
from ..functions.scalars import c, correlation, correlation_p


def numbered(df: DataFrame, key: str = "symbol", time: str = "date") -> DataFrame:
    return df.withColumn("i", F.row_number().over(X.by(key, time)) - 1)


def folds(rows: DataFrame, train: int, test: int, embargo: int = 0, expanding: bool = False, key: str = "symbol", step: int | None = None) -> DataFrame:
    """(key, fold, train_from, train_to, test_from, test_to): half-open row ranges; the last fold may be short.
    Folds start every ``step`` rows, else every ``test``; with a smaller step test ranges overlap."""
    step = step or test
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > train + embargo)
    k = F.ceil((F.col("n") - train - embargo) / step).cast("int")
    f = n.select(key, "n", F.explode(F.sequence(F.lit(0), k - 1)).alias("fold"))
    start = F.lit(0) if expanding else F.col("fold") * step
    at = F.col("fold") * step + train
    return f.select(key, "fold", start.cast("long").alias("train_from"), at.cast("long").alias("train_to"), (at + embargo).cast("long").alias("test_from"), F.least(at + embargo + test, "n").cast("long").alias("test_to"))


def holdout(rows: DataFrame, most: int = 252, share: float = 0.2, least: int = 60, key: str = "symbol") -> DataFrame:
    """Rows with ``slice``: dev or holdout, the last min(most, share of rows); keys with too short a dev part have none."""
    n = F.count(F.lit(1)).over(X.W.partitionBy(key))
    size = F.least(F.lit(most), F.floor(n * share))
    size = F.when(n - size >= least, size).otherwise(0)
    return rows.withColumn("slice", F.when(F.col("i") >= n - size, "holdout").otherwise("dev"))


def in_folds(rows: DataFrame, folds: DataFrame, lo: str, hi: str, key: str | list[str] = "symbol", bucket: int = 128) -> DataFrame:
    """Rows with each fold whose range from ``lo`` to ``hi`` holds their number i. Both sides meet by stretches of
    rows, so a row is joined with the folds near it and not with all of its key."""
    near = F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket)))
    own = folds.where(F.col(lo) < F.col(hi)).withColumn("__bucket", near)
    return rows.withColumn("__bucket", F.floor(F.col("i") / bucket)).join(own, [*([key] if isinstance(key, str) else key), "__bucket"]).where((F.col("i") >= F.col(lo)) & (F.col("i") < F.col(hi))).drop("__bucket")


def soft_descent(a: np.ndarray, b: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Minimises x'ax / 2 - b'x + penalty * |x[1:]|; the first coordinate is the intercept."""
    x = start.copy()
    for _ in range(rounds):
        before = x.copy()
        for j in range(len(x)):
            if a[j, j] > 0:
                rest = b[j] - a[j] @ x + a[j, j] * x[j]
                x[j] = (rest if j == 0 else np.sign(rest) * max(abs(rest) - penalty, 0.0)) / a[j, j]
        if np.abs(x - before).max() < 1e-12:
            break
    return x


def least_squares(rows: DataFrame, folds: DataFrame, x: list[str], y: str, ridge: float = 0.0, key: str = "symbol", lasso: float = 0.0) -> DataFrame:
    """(key, fold, coefficients): Gram sums by Spark, only the small systems are solved in numpy.
    ``lasso`` adds an absolute penalty (of the mean squared error), solved by coordinate descent on the sums."""
    cols = [F.lit(1.0), *map(c, x), c(y)]
    m = len(cols)
    ok = rows.where(" and ".join(f"{v} is not null" for v in [*x, y]))
    own = in_folds(ok, folds, "train_from", "train_to", key)
    gram = own.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(cols[a] * cols[b]) for a in range(m) for b in range(a, m))).alias("g"))

    def solve(batches):
        for b in batches:
            out = []
            for g in b["g"]:
                full = np.zeros((m, m))
                full[np.triu_indices(m)] = g
                full = full + np.triu(full, 1).T
                penalty = ridge * np.diag([0.0] + [1.0] * (m - 2))
                beta = np.linalg.lstsq(full[:-1, :-1] + penalty, full[:-1, -1], rcond=None)[0]
                out.append(soft_descent(full[:-1, :-1] + penalty, full[:-1, -1], lasso * full[0, 0], beta) if lasso else beta)
            yield b.drop(columns="g").assign(coefficients=out)

    kind = rows.schema[key].dataType.simpleString()
    return gram.mapInPandas(solve, f"{key} {kind}, fold int, n long, coefficients array<double>")


def predicted(rows: DataFrame, folds: DataFrame, models: DataFrame, x: list[str], key: str = "symbol") -> DataFrame:
    """Test rows of each fold with ``pred``."""
    own = in_folds(rows, folds, "test_from", "test_to", key).join(models.select(key, "fold", "coefficients"), [key, "fold"])
    pred = F.col("coefficients")[0]
    for k, v in enumerate(x):
        pred = pred + F.col("coefficients")[k + 1] * c(v)
    return own.withColumn("pred", pred)


def finite(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``metrics`` with null in place of NaN and infinities, which compare as larger than any number."""
    kinds = {"double", "float"}
    bad = lambda n: F.isnan(n) | (F.abs(n) == float("inf"))
    return metrics.withColumns({n: F.when(~bad(n), F.col(n)) for n in names if metrics.schema[n].dataType.simpleString() in kinds})


def verdict(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``cleared`` and ``reasons``: a rule that can't be shown to hold fails."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return metrics.withColumn("reasons", reasons).withColumn("cleared", F.size("reasons") == 0)


def robustness(runs: DataFrame, keys: list[str], value: str = "metric_value", swing: float = 0.05) -> DataFrame:
    """Flags of each group of perturbed runs against its base run (``is_base``)."""
    base = F.max(F.when(F.col("is_base"), c(value)))
    probes = F.count(F.when(~F.col("is_base"), c(value)))
    flip = F.max(F.when(~F.col("is_base"), F.signum(value))) != F.min(F.when(~F.col("is_base"), F.signum(value)))
    far = F.max(F.when(~F.col("is_base"), c(value))) - F.min(F.when(~F.col("is_base"), c(value)))
    got = runs.groupBy(*keys).agg(base.alias("base"), probes.alias("n_probes"), flip.alias("flip"), far.alias("far"))
    flags = F.array_compact(F.array(F.when(F.col("base").isNull(), "no_base"), F.when(F.col("n_probes") == 0, "no_probes"), F.when(F.coalesce("flip", F.lit(False)), "sign_flip"), F.when(F.coalesce(F.col("far") > swing, F.lit(False)), "large_swing")))
    got = got.withColumn("flags", flags)
    unclear = F.arrays_overlap("flags", F.array(F.lit("no_base"), F.lit("no_probes")))
    return got.withColumn("verdict", F.when(unclear, "inconclusive").when(F.size("flags") > 0, "fragile").otherwise("robust")).drop("flip", "far")


def horizon_ensemble(preds: DataFrame) -> DataFrame:
    """(symbol, date, horizon, pred, ic) -> mean, median and weighted by max(ic, 0.01)."""
    w = F.greatest("ic", F.lit(0.01))
    return preds.groupBy("symbol", "date").agg(F.avg("pred").alias("mean"), F.percentile("pred", F.lit(0.5)).alias("median"), (F.sum(w * F.col("pred")) / F.sum(w)).alias("weighted"))


def latest_metrics(long: DataFrame, names: list[str], keys: list[str], trained_at: str = "trained_at") -> DataFrame:
    """(keys, metric, value, trained_at) -> a row for each key with the latest finite value of every metric, else null."""
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    got = long.groupBy(*keys, "metric").agg(F.max_by(F.struct(value.alias("v")), trained_at).alias("s"))
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == n, F.col("s.v"))).alias(n) for n in names))


SKILL = ("oos_r2", "qlike_skill_ratio", "folds_passed", "n_folds", "n_obs")
RETURN = ("r2", "direction_accuracy", "folds_passed", "n_folds", "n_obs", "annualised_alpha", "turnover_adjusted_sharpe")


def skill_gate(metrics: DataFrame) -> DataFrame:
    """The volatility model's gate on the columns SKILL: it fails closed. Missing metrics are named; if none is missing,
    implausible ones are; only then the rules are tested. NaN and infinities are missing."""
    metrics = finite(metrics, SKILL)
    c_ = {n: F.col(n) for n in SKILL}
    whole = {n: F.floor(c_[n]) for n in ("folds_passed", "n_folds", "n_obs")}
    missing = F.array_compact(F.array(*(F.when(c_[n].isNull(), F.lit(f"missing {n}")) for n in sorted(SKILL))))
    odd = {
        "implausible oos_r2": c_["oos_r2"] > 1,
        "implausible qlike_skill_ratio": c_["qlike_skill_ratio"] < 0,
        "implausible n_folds": whole["n_folds"] < 1,
        "implausible folds_passed": (whole["folds_passed"] < 0) | (whole["folds_passed"] > whole["n_folds"]),
        "implausible n_obs": whole["n_obs"] < 0,
    }
    odd = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in odd.items())))
    rules = {
        "oos_r2": c_["oos_r2"] >= 0.10,
        "qlike_skill_ratio": c_["qlike_skill_ratio"] < 0.99,
        "folds_passed": whole["folds_passed"] >= F.ceil(0.6 * whole["n_folds"]),
        "n_obs": whole["n_obs"] >= 250,
    }
    failed = F.array_compact(F.array(*(F.when(~v, F.lit(k)) for k, v in rules.items())))
    got = metrics.withColumn("reasons", F.when(F.size(missing) > 0, missing).when(F.size(odd) > 0, odd).otherwise(failed))
    return got.withColumn("cleared", F.size("reasons") == 0)


def return_gate(metrics: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """The return model's gate on the columns RETURN; a rule that can't be shown to hold fails, as with NaN and infinities."""
    metrics = finite(metrics, RETURN)
    folds = F.floor("n_folds")
    rules = {
        "r2": F.col("r2") > 0,
        "direction_accuracy": F.col("direction_accuracy") > 0.5,
        "folds_passed": (folds >= 1) & (F.col("folds_passed") >= 0) & (F.floor("folds_passed") >= F.ceil(0.6 * folds)),
        "n_obs": F.floor("n_obs") >= 252,
        "annualised_alpha": F.abs("annualised_alpha") > cost_bps / 10000,
        "turnover_adjusted_sharpe": F.col("turnover_adjusted_sharpe") > 0,
    }
    return verdict(metrics, rules)


def grid_forecasts(
    rows: DataFrame, targets: dict[int, str], subsets: dict[str, list[str]], trains: list[int], ridges: list[float], test: int = 100, key: str = "symbol", windows: tuple[str, ...] = ("rolling",), unknown: bool = False
) -> DataFrame:
    """Out-of-sample rows of every configuration in one job: key, date, horizon, train, window, features, ridge, fold, y, pred.
    With ``unknown`` also rows of test parts without a target.

    ``targets``: horizon -> column; ``subsets``: name -> columns. The Gram sums of a fold are made once, of all columns;
    subsets and penalties only change the small systems that are solved. A horizon is also the embargo. Windows are rolling or expanding; sums of
    expanding ones are running sums over stretches of ``test`` rows.
    """
    names = sorted({x for xs in subsets.values() for x in xs})
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), c(y).cast("double").alias("y")) for h, y in targets.items())))
    tested = rows.dropna("any", subset=names).select(key, "date", "i", *names, each.alias("t")).select("*", "t.*").drop("t")
    long = tested.where("y is not null")
    every = None
    for h in targets:
        for n in trains:
            f = folds(rows, n, test, h, key=key).withColumns({"horizon": F.lit(h), "train": F.lit(n)})
            every = f if every is None else every.unionByName(f)
    cols = [F.lit(1.0), *map(c, names), F.col("y")]
    m = len(cols)
    pairs = [cols[a] * cols[b] for a in range(m) for b in range(a, m)]
    by = [key, "horizon", "train", "fold"]
    gram = None
    if "rolling" in windows:
        gram = in_folds(long, every, "train_from", "train_to", [key, "horizon"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, pairs)).alias("g")).withColumn("window", F.lit("rolling"))
    if "expanding" in windows:
        length = F.explode(F.array(*map(F.lit, trains))).alias("train")
        own = long.select("*", length).withColumn("fold", F.when(F.col("i") < F.col("train"), 0).otherwise(F.floor((F.col("i") - F.col("train")) / test) + 1).cast("int"))
        parts = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"g{k}") for k, p in enumerate(pairs)))
        upto = X.upto(X.W.partitionBy(key, "horizon", "train").orderBy("fold"))
        grown = parts.select(*by, F.sum("n").over(upto).alias("n"), F.array(*(F.sum(f"g{k}").over(upto) for k in range(len(pairs)))).alias("g"), F.lit("expanding").alias("window"))
        gram = grown if gram is None else gram.unionByName(grown)

    def solve(batches):
        for b in batches:
            parts = []
            for row in b.to_dict("records"):
                full = np.zeros((m, m))
                full[np.triu_indices(m)] = row.pop("g")
                full += np.triu(full, 1).T
                for label, xs in subsets.items():
                    at = [0] + [1 + names.index(x) for x in xs]
                    for ridge in ridges:
                        a = full[np.ix_(at, at)] + ridge * np.diag([0.0] + [1.0] * len(xs))
                        beta = np.zeros(m - 1)
                        beta[at] = np.linalg.lstsq(a, full[at, -1], rcond=None)[0]
                        parts.append({**row, "features": label, "ridge": ridge, "beta": beta})
            yield pd.DataFrame(parts, columns=[key, "horizon", "train", "fold", "n", "window", "features", "ridge", "beta"])

    kind = rows.schema[key].dataType.simpleString()
    models = gram.mapInPandas(solve, f"{key} {kind}, horizon int, train int, fold int, n long, window string, features string, ridge double, beta array<double>")
    out = in_folds(tested if unknown else long, every, "test_from", "test_to", [key, "horizon"]).join(models.drop("n"), by)
    pred = F.col("beta")[0]
    for k, x in enumerate(names):
        pred = pred + F.col("beta")[k + 1] * c(x)
    return out.select(key, "date", "horizon", "train", "window", "features", "ridge", "fold", "y", pred.alias("pred"))


def forecast_scores(out: DataFrame, keys: list[str]) -> DataFrame:
    """n, ic, accuracy, r2, n_folds and folds_passed (folds with R squared above 0) by ``keys``."""
    r2 = 1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("pred"), F.lit(2.0))), F.var_pop("y") * F.count("y"))
    hit = F.when((F.signum("pred") == F.signum("y")) & (F.col("y") != 0), 1.0).otherwise(0.0)
    by_fold = out.groupBy(*keys, "fold").agg(r2.alias("r2")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), F.sum(F.when(F.col("r2") > 0, 1).otherwise(0)).alias("folds_passed"))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("pred", "y").alias("ic"), F.avg(hit).alias("accuracy"), r2.alias("r2")).join(by_fold, keys)


def ensembles(out: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """Forecasts of several horizons of one row -> mean, median and the mean weighted by max(ic, 0.01), of horizons with
    more than ``least`` forecasts: (keys, date, mean, median, weighted). Forecasts count by row of their horizon."""
    ic = out.groupBy(*keys, "horizon").agg(correlation("pred", "y").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least).drop("n")
    w = F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.01))
    each = out.join(ic, [*keys, "horizon"]).withColumn("p", F.col("pred") / F.col("horizon"))
    return each.groupBy(*keys, "date").agg(F.avg("p").alias("mean"), F.percentile("p", F.lit(0.5)).alias("median"), (F.sum(w * F.col("p")) / F.sum(w)).alias("weighted"), F.count(F.lit(1)).alias("n_horizons"))


def evaluated(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """All metrics of forecasts by ``keys`` (horizon among them). ``rows``: keys, date, y, pred, vol (for the regimes, may be null).

    Returns over several rows overlap, so Sharpe ratio and alpha take every horizon-th row of the key. A correlation that is undefined
    counts as 0 with a p-value of 1. Accuracy in a regime is that of the rows in the lower, middle or upper third of vol. Keys with
    fewer than ``least`` forecasts are left out.
    """
    own = rows.where("y is not null and pred is not null")
    w = X.W.partitionBy(*keys).orderBy("date")
    own = own.withColumns({"s": F.signum("pred") * F.col("y"), "j": F.row_number().over(w) - 1, "turned": F.abs(F.col("pred") - F.lag("pred").over(w))})
    third = own.groupBy(*keys).agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"), F.count("vol").alias("n_vol"), F.count(F.lit(1)).alias("n_own"))
    own = own.join(third, keys)
    # with fewer rows than a horizon all of them count
    strided = F.when((F.col("j") % F.col("horizon") == 0) | (F.col("n_own") < F.col("horizon")), F.col("s"))
    hit = F.when((F.signum("pred") == F.signum("y")) & (F.col("y") != 0), 1.0).otherwise(0.0)
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    regimes = {"low": F.col("vol") <= F.col("cut")[0], "medium": (F.col("vol") > F.col("cut")[0]) & (F.col("vol") <= F.col("cut")[1]), "high": F.col("vol") > F.col("cut")[1]}
    got = own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), correlation("pred", "y").alias("ic"), F.avg(hit).alias("direction_accuracy"), share(F.col("y") > 0).alias("positive_target_rate"),
        share(F.col("pred") > 0).alias("positive_prediction_rate"), share(F.col("y") < 0).alias("down"), F.avg(strided).alias("m"), F.stddev_pop(strided).alias("sd"), F.count(strided).alias("n_strided"), F.avg("turned").alias("turnover"),
        *(F.avg(F.when(test & (F.col("n_vol") >= 6), hit)).alias(f"direction_accuracy_{k}") for k, test in regimes.items()),
    ).where(F.col("n") >= least)
    ic = F.when(F.isnan("ic"), None).otherwise(F.col("ic"))
    got = got.withColumns({"ic_pvalue": correlation_p(ic, "n"), "ic": F.coalesce(ic, F.lit(0.0))})
    baseline = F.greatest("positive_target_rate", "down")
    sharpe = F.when((F.col("n_strided") > 1) & (F.col("sd") > 0), F.col("m") / F.col("sd") * F.sqrt(252.0 / F.col("horizon")))
    return got.select(
        *keys, "n", "ic", "ic_pvalue", "direction_accuracy", baseline.alias("baseline_direction_accuracy"), (F.col("direction_accuracy") - baseline).alias("direction_edge"),
        "positive_target_rate", "positive_prediction_rate", *(f"direction_accuracy_{k}" for k in regimes), sharpe.alias("sharpe"), (F.signum("ic") * F.pow("ic", F.lit(2.0))).alias("r2"),
        (F.col("m") * 252 / F.col("horizon")).alias("annualised_alpha"), (sharpe - 0.0005 * F.coalesce("turnover", F.lit(0.0))).alias("turnover_adjusted_sharpe"),
    )


def fold_counts(out: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, n_models, mean_train_rows, n_folds, folds_passed): a fold passes with forecasts that go with the target;
    folds with fewer than ``least`` targets are not judged."""
    by_fold = out.groupBy(*keys, "fold").agg(F.count("y").alias("k"), correlation("pred", "y").alias("ic"), F.max("n_train").alias("n_train"))
    judged = F.col("k") >= least
    good = judged & ~F.isnan("ic") & (F.col("ic") > 0)
    return by_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.floor(F.avg("n_train")).alias("mean_train_rows"), F.count(F.when(judged, 1)).alias("n_folds"), F.count(F.when(good, 1)).alias("folds_passed"))


PENALTIES = (0.1, 1.0, 10.0, 100.0)


def nested_ridge(rows: DataFrame, folds: DataFrame, x: list[str], y: str, penalties: tuple[float, ...] = PENALTIES, splits: int = 3, least: int = 60, key: str = "symbol") -> DataFrame:
    """(key, fold, n, ridge, inner_mse, coefficients): each fold's penalty is chosen inside its training rows only.

    The training rows are cut into ``splits + 1`` stretches. An inner fold trains on all stretches before the one it tests, so its Gram sums are
    running sums of theirs, and its squared error follows from the sums of the tested stretch: rows are read once whatever the grid. Folds
    with fewer than ``least`` rows take the first penalty. ``rows`` has the number i of rows without nulls in ``x`` and ``y``.
    """
    cols = [F.lit(1.0), *map(c, x), c(y)]
    m = len(cols)
    size = F.floor((F.col("train_to") - F.col("train_from")) / (splits + 1))
    at = F.col("i") - F.col("train_from") - (F.col("train_to") - F.col("train_from") - splits * size)
    own = in_folds(rows, folds, "train_from", "train_to", key).withColumn("part", F.when(at < 0, 0).otherwise(F.floor(at / size) + 1).cast("int"))
    sums = F.array(*(F.sum(cols[a] * cols[b]) for a in range(m) for b in range(a, m)))
    parts = own.groupBy(key, "fold", "part").agg(F.count(F.lit(1)).alias("n"), sums.alias("g"))
    gram = parts.groupBy(key, "fold").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "n", "g"))).alias("parts"))  # splits + 1 rows

    def solve(batches):
        upper = np.triu_indices(m)
        shape = np.diag([0.0] + [1.0] * (m - 2))

        def fitted(full: np.ndarray, penalty: float) -> np.ndarray:
            return np.linalg.lstsq(full[:-1, :-1] + penalty * shape, full[:-1, -1], rcond=None)[0]

        for b in batches:
            out = []
            for n, own in zip(b["n"], b["parts"], strict=True):
                each = []
                for p in own:
                    full = np.zeros((m, m))
                    full[upper] = p["g"]
                    each.append((p["n"], full + np.triu(full, 1).T))
                running = np.cumsum([g for _, g in each], axis=0)
                best, loss = penalties[0], np.nan
                if n >= least and len(each) == splits + 1:
                    losses = []
                    for penalty in penalties:
                        total = 0.0
                        for k in range(splits):
                            residual = np.append(-fitted(running[k], penalty), 1.0)
                            total += residual @ each[k + 1][1] @ residual / each[k + 1][0]
                        losses.append(total / splits)
                    best, loss = penalties[int(np.argmin(losses))], min(losses)
                out.append((best, loss, fitted(running[-1], best)))
            got = b[[key, "fold", "n"]].copy()
            got["ridge"], got["inner_mse"], got["coefficients"] = [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]
            yield got

    kind = rows.schema[key].dataType.simpleString()
    return gram.mapInPandas(solve, f"{key} {kind}, fold int, n long, ridge double, inner_mse double, coefficients array<double>")


#: Where a metric shows no skill.
NO_SKILL = {"r2": 0.0, "oos_r2": 0.0, "ic": 0.0, "direction_accuracy": 0.5, "qlike_skill_ratio": 1.0}


def fragility(runs: DataFrame, keys: list[str], swing: float = 0.05, least: int = 1) -> DataFrame:
    """Runs around a base -> (keys, dimension, metric, base, n_probes, lo, hi, mean, swing, flags, verdict).

    ``runs``: keys, dimension ('base' for the base run), probe, metric, value (null where it has none), cleared (the gate's outcome, null where it has none).
    Flags: gate_flip (a probe's gate differs from the base's; of a dimension), sign_flip (a probe on the other side of NO_SKILL), large_swing (a probe further
    than ``swing`` from the base), no_base, no_probes. Hard flags make a pair fragile, missing runs inconclusive.
    """
    base = runs.where("dimension = 'base'").groupBy(*keys, "metric").agg(F.max("value").alias("base"), F.max("cleared").alias("base_cleared"))
    gate = runs.where("dimension = 'base'").groupBy(*keys).agg(F.max("cleared").alias("base_gate"))
    none = F.lit(None).cast("double")
    for name, level in NO_SKILL.items():
        none = F.when(F.col("metric") == name, level).otherwise(none)
    probes = runs.where("dimension <> 'base'").join(gate, keys, "left").join(base.drop("base_cleared"), [*keys, "metric"], "left").withColumn("level", none)
    v = F.col("value")
    got = probes.groupBy(*keys, "dimension", "metric").agg(
        F.max("base").alias("base"), F.count("value").alias("n_probes"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"),
        F.max(F.abs(v - F.col("base"))).alias("swing"), F.bool_or((F.col("base") - F.col("level")) * (v - F.col("level")) < 0).alias("crossed"), F.bool_or(F.col("cleared") != F.col("base_gate")).alias("flipped"),
    )
    # a flipped gate is the dimension's, whichever metric shows it
    flipped = F.max(F.coalesce("flipped", F.lit(False))).over(X.W.partitionBy(*keys, "dimension"))
    no = F.lit(False)
    flags = F.array_compact(F.array(
        F.when(flipped, "gate_flip"), F.when(F.col("base").isNull(), "no_base"), F.when(F.coalesce("crossed", no), "sign_flip"),
        F.when(F.coalesce(F.col("swing") > swing, no), "large_swing"), F.when(F.col("base").isNotNull() & (F.col("n_probes") < least), "no_probes"),
    ))
    got = got.withColumn("flags", flags).drop("crossed", "flipped")
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    return got.withColumn("verdict", F.when(has("gate_flip", "sign_flip", "large_swing"), "fragile").when(has("no_base", "no_probes"), "inconclusive").otherwise("robust"))


def metrics_table(metrics: DataFrame, names: tuple[str, ...], prefix: str = "return_") -> DataFrame:
    """(model, symbol, metric, value) of the models that begin with ``prefix`` -> symbol and a column for each name, null where a symbol has no such
    metric; the highest correlation first, then the highest accuracy, nulls last. A metric that stands twice counts with its greater value."""
    wide = metrics.where(F.col("model").startswith(prefix)).groupBy("symbol").pivot("metric", list(names)).agg(F.max("value"))
    return wide.select("symbol", *names).orderBy(F.desc_nulls_last("ic"), F.desc_nulls_last("direction_accuracy"))
