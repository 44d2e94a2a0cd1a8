"""Gradient-boosted trees over histograms, fitted for every key, horizon and fold in one job.

Spark deals the rows of a fold to a group (a training window is bounded by its length, an expanding one by the key's
history); inside the task all nodes of a level are split at once: one bincount over (node, feature, bin) sums gradients and counts, running
sums over bins give the gain of every cut, and missing values go to the side that gains more. Values are cut at quantiles of the
training rows. Nothing is drawn at random, so a fold's forecasts are the same wherever and whenever they are made.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import in_folds


@dataclass(frozen=True)
class Boost:
    """Rounds, depth, learning rate, least rows of a leaf, squared penalty on leaves, most bins of a feature."""

    rounds: int = 150
    depth: int = 4
    rate: float = 0.1
    least: int = 20
    l2: float = 0.0
    bins: int = 128


#: The grid of nested tuning.
GRID = {"rate": (0.03, 0.08), "depth": (3, 4), "l2": (0.0, 0.1, 1.0), "rounds": (50, 100)}


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each column: between all distinct values if they are few, else at even quantiles."""
    out = []
    for v in x.T:
        v = v[~np.isnan(v)]  # noqa: PLW2901
        own = np.unique(v)
        if len(own) <= bins:
            out.append((own[:-1] + own[1:]) / 2)
        else:
            out.append(np.unique(np.percentile(v, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")))
    return out


def binned(x: np.ndarray, thresholds: list[np.ndarray], bins: int) -> np.ndarray:
    """Number of the bin of each value; missing values have the last number."""
    return np.column_stack([np.where(np.isnan(v), bins, np.searchsorted(t, v)) for v, t in zip(x.T, thresholds, strict=True)])


@dataclass
class Tree:
    """A full binary tree as arrays: node k has children 2k + 1 and 2k + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray, missing: int) -> np.ndarray:
        at, rows = np.zeros(len(codes), "i8"), np.arange(len(codes))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            code = codes[rows, np.maximum(f, 0)]
            left = np.where(code == missing, self.missing_left[at], code <= self.cut[at])
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at


def grow(codes: np.ndarray, gradient: np.ndarray, how: Boost) -> tuple[Tree, np.ndarray]:
    """A tree for the gradients of a squared error, and each row's leaf."""
    n, p = codes.shape
    size, wide = 2 ** (how.depth + 1) - 1, how.bins + 1
    tree = Tree(np.full(size, -1), np.zeros(size, "i8"), np.zeros(size, bool), np.zeros(size))
    at, growing = np.zeros(n, "i8"), np.ones(n, bool)
    columns = np.arange(p)
    for level in range(how.depth):
        first = 2**level - 1
        # nodes too small to be split are done
        open_nodes = np.flatnonzero(np.bincount(at[growing] - first, minlength=2**level) >= 2 * how.least)
        nodes = len(open_nodes)
        if not nodes:
            break
        number = np.full(2**level, -1)
        number[open_nodes] = np.arange(nodes)
        growing[growing] = number[at[growing] - first] >= 0
        rows = np.flatnonzero(growing)
        slot = ((number[at[rows] - first][:, None] * p + columns) * wide + codes[rows]).ravel()
        g = np.bincount(slot, np.repeat(gradient[rows], p), nodes * p * wide).reshape(nodes, p, wide)
        k = np.bincount(slot, minlength=nodes * p * wide).reshape(nodes, p, wide)
        g_all, k_all = g[:, :1].sum(2, keepdims=True), k[:, :1].sum(2, keepdims=True)
        g_left, k_left = np.cumsum(g[..., :-1], 2), np.cumsum(k[..., :-1], 2)

        def gains(g_left: np.ndarray, k_left: np.ndarray) -> np.ndarray:
            k_right = k_all - k_left  # noqa: B023
            ok = (k_left >= how.least) & (k_right >= how.least)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = g_left**2 / (k_left + how.l2) + (g_all - g_left) ** 2 / (k_right + how.l2)  # noqa: B023
            return np.where(ok, own, -np.inf)

        # missing values to the right, then, where there are any, to the left
        sides = [gains(g_left, k_left)]
        if k[..., -1].any():
            sides.append(gains(g_left + g[..., -1:], k_left + k[..., -1:]))
        both = np.stack(sides, 2).reshape(nodes, -1)
        best = both.argmax(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gained = both[np.arange(nodes), best] - (g_all**2 / (k_all + how.l2))[:, 0, 0]
        split = gained > 1e-12 * np.abs(both[np.arange(nodes), best])
        f, left, cut = best // (len(sides) * how.bins), best // how.bins % len(sides), best % how.bins
        here = first + open_nodes[split]
        tree.feature[here], tree.cut[here], tree.missing_left[here] = f[split], cut[split], left[split] == 1
        own = at[rows]
        goes = tree.feature[own] >= 0
        growing[rows[~goes]] = False
        rows, own = rows[goes], own[goes]
        code = codes[rows, tree.feature[own]]
        to_left = np.where(code == how.bins, tree.missing_left[own], code <= tree.cut[own])
        at[rows] = 2 * own + 2 - to_left
    k, g = np.bincount(at, minlength=size), np.bincount(at, gradient, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        tree.value = np.where(k > 0, -how.rate * g / (k + how.l2), 0.0)
    return tree, at


class Model:
    """Boosted trees fitted on rows ``x`` (missing values are NaN) and ``y``; columns that don't vary are left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Boost):
        self.how = how
        with np.errstate(invalid="ignore"):
            self.used = np.array([np.nanmax(v, initial=-np.inf) > np.nanmin(v, initial=np.inf) for v in x.T])
        self.thresholds = cuts(x[:, self.used], how.bins)
        codes = binned(x[:, self.used], self.thresholds, how.bins)
        self.base, self.trees = y.mean(), []
        pred = np.full(len(y), self.base)
        for _ in range(how.rounds):
            tree, at = grow(codes, pred - y, how)
            self.trees.append(tree)
            pred = pred + tree.value[at]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Forecasts after each round, from none on."""
        codes = binned(x[:, self.used], self.thresholds, self.how.bins)
        each = [t.value[t.leaves(codes, self.how.bins)] for t in self.trees]
        return self.base + np.cumsum(np.vstack([np.zeros(len(x)), *each]), 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x)[-1]


def inner_splits(n: int, splits: int = 3) -> list[tuple[int, int]]:
    """(train_to, test_to) of expanding folds inside ``n`` rows; a test part is ``n // (splits + 1)`` rows."""
    t = n // (splits + 1)
    return [(n - (splits - k) * t, n - (splits - k - 1) * t) for k in range(splits)]


def tuned(x: np.ndarray, y: np.ndarray, how: Boost, least: int = 60) -> Boost:
    """The point of ``GRID`` with the least squared error over three expanding folds inside these rows; ``how`` if they are fewer than ``least``.
    Numbers of rounds are read from the steps of one fit."""
    if len(y) < least:
        return how
    points = list(product(GRID["rate"], GRID["depth"], GRID["l2"]))
    losses = {}
    for rate, depth, l2 in points:
        tried = replace(how, rate=rate, depth=depth, l2=l2, rounds=max(GRID["rounds"]))
        total = np.zeros(len(GRID["rounds"]))
        for to, end in inner_splits(len(y)):
            steps = Model(x[:to], y[:to], tried).steps(x[to:end])[list(GRID["rounds"])]
            total += ((steps - y[to:end]) ** 2).mean(1)
        losses |= {replace(tried, rounds=r): v for r, v in zip(GRID["rounds"], total, strict=True)}
    return min(losses, key=losses.get)


def dealt(rows: DataFrame, folds: DataFrame, key: list[str]) -> DataFrame:
    """Rows once for each fold that trains on or tests them, with ``role``."""
    parts = [in_folds(rows, folds, f"{r}_from", f"{r}_to", key).withColumn("role", F.lit(r)) for r in ("train", "test")]
    return parts[0].unionByName(parts[1]).drop("train_from", "train_to", "test_from", "test_to")


def _matrix(part: pd.DataFrame, x: list[str]) -> np.ndarray:
    return part[x].to_numpy("f8", na_value=np.nan)


def _split(part: pd.DataFrame, x: list[str], least: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray] | None:
    """Train and test rows in order, and the training matrix; none with fewer than ``least`` targets or two columns that vary."""
    part = part.sort_values("i", kind="stable")
    train, test = part[(part.role == "train") & part.y.notna()], part[part.role == "test"]
    a = _matrix(train, x)
    if len(train) < least or sum(np.nanmax(v, initial=-np.inf) > np.nanmin(v, initial=np.inf) for v in a.T) < 2:
        return None
    return train, test, a, train.y.to_numpy("f8")


def forecasts(rows: DataFrame, groups: list[str], x: list[str], how: Boost | None = None, least: int = 50, tune: bool = False, keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """Test rows of every group with n_train, train_mean and pred: (groups, keep, i, y, n_train, train_mean, pred).

    ``rows`` has role (train or test), i (order), y and the columns ``x``, where nulls are allowed. Groups with fewer than ``least`` training
    targets or with fewer than two columns that vary are left out. ``tune`` picks the group's parameters inside its training rows.
    """
    how = how or Boost()
    columns = [*groups, *keep, "i", "y"]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in columns) + ", n_train long, train_mean double, pred double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        got = _split(part, x, least)
        if got is None or got[1].empty:
            return part[columns].iloc[:0].assign(n_train=0, train_mean=0.0, pred=0.0)
        _, test, a, y = got
        model = Model(a, y, tuned(a, y, how) if tune else how)
        return test[columns].assign(n_train=len(y), train_mean=y.mean(), pred=model.predict(_matrix(test, x)))

    return rows.select(*columns, "role", *x).groupBy(*groups).applyInPandas(fit, schema)


def walk_forward(
    rows: DataFrame, targets: dict[int, str], x: list[str], train: int = 252, test: int = 252, step: int | None = None, expanding: bool = False, how: Boost | None = None, key: str = "symbol", tune: bool = False
) -> DataFrame:
    """Out-of-sample forecasts of all horizons in one job: key, horizon, fold, date, i, y, n_train, train_mean, pred.

    ``rows`` has one row for each key and date and the columns of ``targets`` (horizon -> column) and ``x``. Of each horizon the rows with a target and any
    feature are numbered; a horizon less one is the embargo. With a ``step`` below ``test`` windows overlap, and a row has several forecasts.
    """
    from .evaluation import folds

    long, every = None, None
    for h, y in targets.items():
        own = rows.withColumn("y", F.col(y).cast("double")).where(F.col("y").isNotNull() & F.coalesce(*x).isNotNull()).select(key, "date", "y", *x)
        own = own.withColumns({"horizon": F.lit(h), "i": (F.row_number().over(W.partitionBy(key).orderBy("date")) - 1).cast("long")})
        f = folds(own, train, test, h - 1, expanding, key, step).withColumn("horizon", F.lit(h))
        long, every = (own, f) if long is None else (long.unionByName(own), every.unionByName(f))
    return forecasts(dealt(long, every, [key, "horizon"]), [key, "horizon", "fold"], x, how, tune=tune)


def combined(out: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each row forecast: y, mean and median of the forecasts of all its windows, and how many there are."""
    return out.groupBy(*keys, "date").agg(F.max("i").alias("i"), F.max("y").alias("y"), F.avg("pred").alias("mean"), F.percentile("pred", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_windows"))


def with_partners(rows: DataFrame, groups: list[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """``rows`` (with i) and, for each repeat, the place in the group's order of the row whose value takes its row's place: the group's
    rows by a hash of their number, so a permutation is the same on every run and engine size."""
    own = W.partitionBy(*groups)
    return rows.withColumns({f"partner{k}": F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed + k), "i"), "i")) - 1 for k in range(repeats)})


def importances(rows: DataFrame, groups: list[str], x: list[str], how: Boost | None = None, repeats: int = 3, seed: int = 42, least: int = 50) -> DataFrame:
    """(groups, feature, importance): by how much R squared falls on a group's rows when a column is permuted, the mean of the ``repeats``.

    ``rows`` has i, y and ``x``; a model is fitted for each group, and columns that don't vary in it have no row.
    """
    how = how or Boost()
    own = with_partners(rows.where("y is not null"), groups, repeats, seed)
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in groups) + ", feature string, importance double"
    partners = [f"partner{k}" for k in range(repeats)]

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        got = _split(part.assign(role="train"), x, least)
        if got is None:
            return part[groups].iloc[:0].assign(feature="", importance=0.0)
        train, _, a, y = got
        model = Model(a, y, how)
        spread = ((y - y.mean()) ** 2).sum()
        whole = ((y - model.predict(a)) ** 2).sum()
        out = []
        for k in np.flatnonzero(model.used):
            worse = []
            for p in partners:
                mixed = a.copy()
                mixed[:, k] = a[train[p].to_numpy(), k]
                worse.append((((y - model.predict(mixed)) ** 2).sum() - whole) / spread)
            out.append((x[k], float(np.mean(worse))))
        return pd.DataFrame(out, columns=["feature", "importance"]).assign(**{g: train[g].iloc[0] for g in groups})[[*groups, "feature", "importance"]]

    return own.select(*groups, "i", "y", *x, *partners).groupBy(*groups).applyInPandas(measure, schema)


def latest(rows: DataFrame, x: list[str], train: int = 252, horizon: int = 1, how: Boost | None = None, tune: bool = True, key: str = "symbol") -> DataFrame:
    """The calibrated forecast after each key's last row: key, date, raw, train_mean, bound, calibrated.

    ``rows`` has daily_return, y (null where unknown) and ``x``. A model is fitted on the ``train`` rows before the last one; its
    forecast is shrunk half way to their mean and kept within 1.5 deviations of the last 60 returns over the horizon, 0.05 at least.
    """
    last = W.partitionBy(key).orderBy(F.col("date").desc())
    own = rows.where(F.coalesce(*x).isNotNull()).withColumn("back", F.row_number().over(last)).where(F.col("back") <= train + 1)
    own = own.withColumns({"role": F.when(F.col("back") == 1, "test").otherwise("train"), "i": (train + 1 - F.col("back")).cast("long"), "y": F.when(F.col("back") > 1, F.col("y"))})
    enough = own.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("n") == train + 1)
    got = forecasts(enough, [key], x, how, tune=tune).withColumnRenamed("pred", "raw")
    recent = rows.withColumn("back", F.row_number().over(last)).where("back <= 60").groupBy(key).agg((F.stddev_samp("daily_return") * F.sqrt(F.lit(float(horizon)))).alias("sd"))
    bound = F.greatest(F.lit(0.05), 1.5 * F.when(F.col("sd") > 0, F.col("sd")).otherwise(0.15))
    got = got.join(recent, key).withColumn("bound", bound)
    mixed = 0.5 * F.col("raw") + 0.5 * F.col("train_mean")
    return got.select(key, "date", "raw", "train_mean", "bound", F.greatest(-F.col("bound"), F.least(F.col("bound"), mixed)).alias("calibrated"))


