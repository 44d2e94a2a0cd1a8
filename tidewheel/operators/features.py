"""Leakage-free feature sets: named window expressions over one sort of each key.

A set is a list of names (``names``). ``feature_set`` computes one in three layers: what is joined (macro values
as of each date, other assets' returns), window expressions over that, and expressions over those windows. Every
layer is one projection, so Catalyst shares a symbol's sort among all of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import windows as X
from ..functions.scalars import garman_klass
from .evaluation import in_folds
from .series import asof_multi


def _w() -> WindowSpec:
    return X.by("symbol")


def _past(fn, x: str | Column, n: int, least: int, skip: int = 0) -> Column:
    """An aggregate of the ``n`` rows before the current one (and before ``skip`` more)."""
    return X.rolling(fn, x, _w().rowsBetween(-n - skip, -1 - skip), least)


def _lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(_w())


def _change(x: str, n: int, lag: int = 1) -> Column:
    return _lag(x, lag) - _lag(x, lag + n)


def _growth(x: str, n: int, lag: int = 1) -> Column:
    return F.try_divide(_lag(x, lag), _lag(x, lag + n)) - 1


def _per(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _zscore(x: str, n: int, least: int) -> Column:
    """The previous row's score within the ``n`` rows that end with it."""
    return _per(_lag(x) - _past(F.avg, x, n, least), _past(F.stddev_samp, x, n, least))


RET = "daily_return"
#: Names by group, in the order of the sets.
GROUPS = {
    "default": ["ret_lag1", "ret_lag2", "ret_lag3", "ret_lag5", "roll_mean5", "roll_std5", "roll_mean10", "roll_std10", "roll_mean20", "roll_std20"],
    "vol": ["gk_vol", "har_vol_1d", "har_vol_5d", "har_vol_22d", "rv_trail_10d", "rv_trail_63d"],
    "macro": [
        "yc_10y2y_lag1", "yc_10y2y_change_20d", "yc_slope_zscore_60d", "us_10y_lag1", "us_2y_lag1", "us_3m_lag1", "us_10y_change_20d", "fedfunds_lag1", "fedfunds_change_60d", "vix_level_lag1",
        "vix_change_5d", "vix_zscore_60d", "wti_change_20d", "dollar_change_20d", "claims_change_4w", "nfci_lag1", "nfci_change_20d", "gld_vol_20d_lag1", "tlt_vol_20d_lag1",
        "cape", "excess_cape_yield", "div_yield", "earn_yield",
    ],
    "medium": ["vol_of_vol_5d", "vol_of_vol_22d", "vol_dispersion", "ret_momentum_63d", "ret_reversal_5d", "ret_reversal_20d", "ret_vol_ratio_5d_20d", "ret_trend_strength", "vix_x_yc_slope", "nfci_x_dollar_zscore"],
    "rich": [
        "ret_kurt_20d", "ret_skew_20d", "ret_max_20d", "vol_of_vol_5d", "vol_of_vol_22d", "vol_dispersion", "corr_spy_tlt_20d", "corr_spy_gld_20d", "corr_spy_tlt_zscore_60d", "corr_spy_gld_zscore_60d",
        "dollar_zscore_60d", "cross_asset_dispersion_20d", "equity_bond_spread_20d", "day_of_week", "month_of_year", "vix_x_yc_slope", "vol_disp_x_vol_of_vol", "nfci_x_dollar_zscore", "skew_x_vol_dispersion",
        "ret_momentum_63d", "ret_momentum_126d", "ret_momentum_252d", "ret_reversal_5d", "ret_reversal_20d", "ret_vol_ratio_5d_20d", "ret_trend_strength", "ret_autocorr_20d", "yc_slope_x_vix", "momentum_x_vol",
    ],
    "extended": [
        "indpro_growth_1y", "cpi_inflation_1y", "core_pce_inflation_1y", "unrate_level", "unrate_change_3m", "payems_growth_1m", "payems_growth_1y", "m2_growth_1y", "walcl_growth_4w", "umcsent_level",
        "umcsent_change_1m", "sahm_rule_level", "breakeven_inflation_20d", "breakeven_inflation_60d", "breakeven_inflation_change_20d", "recession_prob_lag1", "recession_prob_change_20d", "spy_gld_spread_20d",
        "gld_tlt_spread_20d", "vea_spy_spread_20d", "spy_tip_spread_20d", "btc_spy_spread_20d", "mom_21d", "mom_accel", "rev_10d", "ret_zscore_20d", "ret_zscore_60d", "dist_from_mean_20d", "dist_from_mean_60d", "trend_60d",
    ],
    "mom_rev": ["mom_21d", "mom_63d", "mom_126d", "mom_252d", "mom_accel", "rev_5d", "rev_10d", "ret_zscore_20d", "ret_zscore_60d", "dist_from_mean_20d", "dist_from_mean_60d", "trend_20d", "trend_60d"],
}
SETS = {
    "default": ("default",),
    "vol": ("default", "vol"),
    "vol_macro": ("default", "vol", "macro"),
    "vol_medium": ("default", "vol", "macro", "medium"),
    "vol_rich": ("default", "vol", "macro", "rich"),
    "vol_rich_plus": ("default", "vol", "macro", "rich", "extended"),
    "mom_rev": ("default", "mom_rev"),
}
#: Rows by which a series is published after its date, in the extended set.
PUBLISHED = {"INDPRO": 30, "CPIAUCSL": 30, "PCEPILFE": 30, "UNRATE": 22, "PAYEMS": 22, "M2SL": 22, "WALCL": 5, "UMCSENT": 15, "SAHMREALTIME": 22}
SERIES = (
    "T10Y2Y", "DGS10", "DGS2", "DGS3MO", "FEDFUNDS", "VIXCLS", "DCOILWTICO", "DTWEXBGS", "ICSA", "NFCI", *PUBLISHED, "recession_prob", "cape", "excess_cape_yield", "div_yield", "earn_yield",
)
ASSETS = ("gld", "tlt", "vea", "tip", "btc")


def names(which: str) -> list[str]:
    """The ordered column names of a set."""
    return [n for g in SETS[which] for n in GROUPS[g]]


def default() -> dict[str, Column]:
    out = {f"ret_lag{k}": _lag(RET, k) for k in (1, 2, 3, 5)}
    for n in (5, 10, 20):
        out |= {f"roll_mean{n}": X.rolling(F.avg, RET, X.last_n(_w(), n), n), f"roll_std{n}": X.rolling(F.stddev_samp, RET, X.last_n(_w(), n), n)}
    return out


def volatility() -> dict[str, Column]:
    """One-bar volatility, its means over 1, 5 and 22 bars before and its deviations."""
    out = {"gk_vol": F.col("gk")} | {f"har_vol_{n}d": _past(F.avg, "gk", n, 1) for n in (1, 5, 22)}
    return out | {f"rv_trail_{n}d": _past(F.stddev_samp, "gk", n, 1) for n in (10, 63)}


def momentum() -> dict[str, Column]:
    out = {f"mom_{n}d": _past(F.sum, RET, n, least) for n, least in ((21, 10), (63, 30), (126, 60), (252, 120))}
    out["mom_accel"] = out["mom_63d"] - _past(F.sum, RET, 63, 30, skip=21)
    return out | {"rev_5d": -_past(F.sum, RET, 5, 3)} | reversion() | {"trend_20d": trend(20)}


def trend(n: int) -> Column:
    return _per(F.abs(_past(F.avg, RET, n, n // 2)), _past(F.stddev_samp, RET, n, n // 2))


def reversion() -> dict[str, Column]:
    out = {"rev_10d": -_past(F.sum, RET, 10, 5)}
    for n in (20, 60):
        out |= {f"ret_zscore_{n}d": _zscore(RET, n, n // 2), f"dist_from_mean_{n}d": F.when(F.count(RET).over(X.before_n(_w(), n)) >= n // 2, _lag(RET) - F.avg(RET).over(X.before_n(_w(), n)))}
    return out | {"trend_60d": trend(60)}


def macro() -> dict[str, Column]:
    """Levels as of the row before, changes and scores; these are carried forward in the next layer."""
    out = {"yc_10y2y_lag1": _lag("T10Y2Y"), "yc_10y2y_change_20d": _change("T10Y2Y", 20), "yc_slope_zscore_60d": _zscore("T10Y2Y", 60, 20)}
    out |= {f"{n}_lag1": _lag(s) for n, s in (("us_10y", "DGS10"), ("us_2y", "DGS2"), ("us_3m", "DGS3MO"), ("fedfunds", "FEDFUNDS"), ("vix_level", "VIXCLS"), ("nfci", "NFCI"))}
    out |= {"us_10y_change_20d": _change("DGS10", 20), "fedfunds_change_60d": _change("FEDFUNDS", 60), "vix_change_5d": _change("VIXCLS", 5), "vix_zscore_60d": _zscore("VIXCLS", 60, 20)}
    out |= {"wti_change_20d": _growth("DCOILWTICO", 20), "dollar_change_20d": _growth("DTWEXBGS", 20), "nfci_change_20d": _change("NFCI", 20)}
    out["claims_change_4w"] = _past(F.avg, "ICSA", 4, 1) - _past(F.avg, "ICSA", 4, 1, skip=4)
    return out | {n: F.col(n) for n in ("cape", "excess_cape_yield", "div_yield", "earn_yield")}


def medium() -> dict[str, Column]:
    out = {"vol_of_vol_5d": _past(F.stddev_samp, "gk", 5, 3), "vol_of_vol_22d": _past(F.stddev_samp, "gk", 22, 10)}
    out["vol_dispersion"] = _past(F.avg, "gk", 5, 3) - _past(F.avg, "gk", 22, 10)
    out |= {"ret_momentum_63d": _past(F.sum, RET, 63, 31), "ret_reversal_5d": _past(F.sum, RET, 5, 5), "ret_reversal_20d": _past(F.sum, RET, 20, 20)}
    out["ret_vol_ratio_5d_20d"] = _per(_past(F.stddev_samp, RET, 5, 3), _past(F.stddev_samp, RET, 20, 10))
    return out | {"ret_trend_strength": trend(20), "dollar_zscore_60d": _zscore("DTWEXBGS", 60, 20)}


def rich() -> dict[str, Column]:
    f = X.last_n(_w(), 20)
    out = medium() | {"ret_kurt_20d": X.kurt(RET, f, 10), "ret_skew_20d": X.skew(RET, f, 10), "ret_max_20d": X.rolling(F.max, RET, f, 10)}
    for a in ("tlt", "gld"):
        both = F.when(F.col(RET).isNotNull() & F.col(f"{a}_ret").isNotNull(), F.lit(1))
        out[f"raw_corr_{a}"] = F.round(X.enough(F.corr(RET, f"{a}_ret").over(f), both, f, 10), 9)  # 1 is 1, so its deviation is 0
    apart = F.abs(F.col("gld_ret") - F.col("tlt_ret")) / F.sqrt(F.lit(2.0))
    out |= {"cross_asset_dispersion_20d": _past(F.avg, apart, 20, 10), "equity_bond_spread_20d": _past(F.avg, F.col(RET) - F.col("tlt_ret"), 20, 10)}
    out |= {"day_of_week": F.weekday("date") / 4.0, "month_of_year": F.month("date") / 12.0}
    out |= {"ret_momentum_126d": _past(F.sum, RET, 126, 63), "ret_momentum_252d": _past(F.sum, RET, 252, 126)}
    pair, g = F.when(F.col(RET).isNotNull() & F.col("before").isNotNull(), F.lit(1)), X.before_n(_w(), 19)
    return out | {"ret_autocorr_20d": X.enough(F.corr(RET, "before").over(g), pair, g, 14)}


def extended() -> dict[str, Column]:
    known = lambda s, n=0: _lag(s, PUBLISHED[s] + n)
    out = {n: _growth(s, 252, PUBLISHED[s]) for n, s in (("indpro_growth_1y", "INDPRO"), ("cpi_inflation_1y", "CPIAUCSL"), ("core_pce_inflation_1y", "PCEPILFE"), ("payems_growth_1y", "PAYEMS"), ("m2_growth_1y", "M2SL"))}
    out |= {"payems_growth_1m": _growth("PAYEMS", 21, PUBLISHED["PAYEMS"]), "walcl_growth_4w": _growth("WALCL", 20, PUBLISHED["WALCL"])}
    out |= {"unrate_level": known("UNRATE"), "umcsent_level": known("UMCSENT"), "sahm_rule_level": known("SAHMREALTIME")}
    out |= {"unrate_change_3m": known("UNRATE") - known("UNRATE", 63), "umcsent_change_1m": known("UMCSENT") - known("UMCSENT", 21)}
    even = F.col("tlt_ret") - F.col("tip_ret")
    out |= {"breakeven_inflation_20d": _past(F.avg, even, 20, 10), "breakeven_inflation_60d": _past(F.avg, even, 60, 20)}
    out["breakeven_inflation_change_20d"] = out["breakeven_inflation_20d"] - _past(F.avg, even, 20, 10, skip=20)
    out |= {"recession_prob_lag1": _lag("recession_prob"), "recession_prob_change_20d": _change("recession_prob", 20)}
    for name, a in (("spy_gld", "gld"), ("vea_spy", "vea"), ("spy_tip", "tip"), ("btc_spy", "btc")):
        out[f"{name}_spread_20d"] = _past(F.avg, F.col(RET) - F.col(f"{a}_ret"), 20, 10)
    out["gld_tlt_spread_20d"] = _past(F.avg, F.col("gld_ret") - F.col("tlt_ret"), 20, 10)
    out["mom_21d"] = _past(F.sum, RET, 21, 10)
    return out | {"mom_accel": out["mom_21d"] - _past(F.sum, RET, 21, 10, skip=21)} | reversion()


BUILD = {"default": default, "vol": volatility, "macro": macro, "medium": medium, "rich": rich, "extended": extended, "mom_rev": momentum}


def joined(daily: DataFrame, macro_series: DataFrame | None, assets: dict[str, str]) -> DataFrame:
    """Bars with one-bar volatility, the return before, macro values as of each date and the returns and volatility
    of other assets on it. ``macro_series``: series_id, date, value; ``assets``: label -> symbol. What is missing is null."""
    rows = daily.select("symbol", "date", "open", "high", "low", "close", RET).withColumns({"gk": garman_klass("open", "high", "low", "close"), "before": F.lag(RET).over(_w())})
    if macro_series is not None:
        dates = rows.select("date").distinct()
        known = asof_multi(dates, macro_series, {s: F.when(F.col("series_id") == s, F.col("value")) for s in SERIES})
        rows = rows.join(known, "date", "left")
    else:
        rows = rows.withColumns({s: F.lit(None).cast("double") for s in SERIES})
    vol = X.rolling(F.stddev_samp, RET, X.last_n(_w(), 20), 10) * F.sqrt(F.lit(252.0))
    others = daily.where(F.col("symbol").isin(*assets.values())).select("symbol", "date", RET, vol.alias("vol"))
    of = lambda a, x: F.max(F.when(F.col("symbol") == assets.get(a, ""), F.col(x)))
    wide = others.groupBy("date").agg(*(of(a, RET).alias(f"{a}_ret") for a in ASSETS), *(of(a, "vol").alias(f"{a}_vol") for a in ("gld", "tlt")))
    return rows.join(wide, "date", "left")


def feature_set(daily: DataFrame, which: str = "default", macro_series: DataFrame | None = None, assets: dict[str, str] | None = None) -> DataFrame:
    """symbol, date and the columns of ``names(which)``.

    ``daily``: symbol, date, open, high, low, close, daily_return. Only rows up to a date enter its features. Series or assets
    that are not given leave their features null.
    """
    groups = SETS[which]
    more = "macro" in groups
    rows = joined(daily, macro_series, assets or {}) if more else daily.withColumn("gk", garman_klass("open", "high", "low", "close"))
    made = {k: v for g in groups for k, v in BUILD[g]().items()}
    if more:
        made |= {f"{a}_vol_20d_lag1": _lag(f"{a}_vol") for a in ("gld", "tlt")}
    rows = rows.select("symbol", "date", *(v.alias(k) for k, v in made.items()))
    if more:
        rows = rows.withColumns({k: X.ffill(k, _w()) for k in macro()})
    if "rich" in groups:
        rows = rows.withColumns({f"corr_spy_{a}_zscore_60d": _zscore(f"raw_corr_{a}", 60, 20) for a in ("tlt", "gld")} | {f"corr_spy_{a}_20d": X.ffill(f"raw_corr_{a}", _w()) for a in ("tlt", "gld")})
    if "medium" in groups or "rich" in groups:
        times = lambda a, b: F.col(a) * F.col(b)
        rows = rows.withColumns({"vix_x_yc_slope": times("vix_zscore_60d", "yc_slope_zscore_60d"), "nfci_x_dollar_zscore": times("nfci_lag1", "dollar_zscore_60d")})
    if "rich" in groups:
        products = {"vol_disp_x_vol_of_vol": ("vol_dispersion", "vol_of_vol_22d"), "skew_x_vol_dispersion": ("ret_skew_20d", "vol_dispersion"), "yc_slope_x_vix": ("yc_slope_zscore_60d", "vix_level_lag1"), "momentum_x_vol": ("ret_momentum_63d", "gk_vol")}
        rows = rows.withColumns({k: times(*v) for k, v in products.items()})
    return rows.select("symbol", "date", *names(which))


def informative(rows: DataFrame, columns: list[str], folds: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, fold, kept): the columns that vary within each fold's training rows; rows without any value of
    ``columns`` don't count. ``rows`` has the row number i, ``folds`` the ranges train_from and train_to."""
    some = rows.dropna("all", subset=columns)
    own = in_folds(some, folds, "train_from", "train_to", key)
    sd = own.groupBy(key, "fold").agg(*(F.stddev_pop(n).alias(n) for n in columns))
    return sd.select(key, "fold", F.array_compact(F.array(*(F.when(F.col(n) > 0, F.lit(n)) for n in columns))).alias("kept"))


def with_features(daily: DataFrame, *sets: dict[str, Column]) -> DataFrame:
    """symbol, date and the given expressions; Catalyst evaluates all over one sort."""
    rows = daily.withColumn("gk", garman_klass("open", "high", "low", "close"))
    every = {k: v for s in sets for k, v in s.items()}
    return rows.select("symbol", "date", *(v.alias(k) for k, v in every.items()))


def dispersion(daily: DataFrame) -> DataFrame:
    """Each date's deviation of returns across symbols."""
    return daily.groupBy("date").agg(F.count("daily_return").alias("n"), F.stddev_samp("daily_return").alias("dispersion"))


def published(macro: DataFrame, lags: dict[str, int], otherwise: int = 1) -> DataFrame:
    """Each series as known ``lags`` rows later."""
    w = X.by("series_id")
    lag = F.lit(otherwise)
    for s, n in lags.items():
        lag = F.when(F.col("series_id") == s, F.lit(n)).otherwise(lag)
    known = F.array(*(F.lag("value", k).over(w) for k in sorted({*lags.values(), otherwise})))
    at = F.array_position(F.array(*map(F.lit, sorted({*lags.values(), otherwise}))), lag)
    return macro.withColumn("known", F.element_at(known, at.cast("int")))


def target(kind: str) -> Column:
    """raw, vol_adjusted (by 20-bar deviation) or excess (over the 60-bar median)."""
    if kind == "raw":
        return F.col("daily_return")
    if kind == "vol_adjusted":
        sd = X.rolling(F.stddev_samp, "daily_return", X.last_n(_w(), 20), 10)
        return F.col("daily_return") / F.nullif(sd, F.lit(0.0))
    return F.col("daily_return") - X.rolling(lambda x: F.percentile(x, F.lit(0.5)), "daily_return", X.last_n(_w(), 60), 20)
