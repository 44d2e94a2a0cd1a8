"""The feature sets with their SQL, over all symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..sources import bars
from .registry import d, daily, query, r

ASSETS = {"gld": "Brand#12", "tlt": "Brand#23", "vea": "Brand#34", "tip": "Brand#45", "btc": "Brand#51"}
O = "(partition by symbol order by date)"  # noqa: E741
RET = "daily_return"
#: Digits of the results; both engines round what is a little off the ties.
DIGITS = 5


def over(agg: str, x: str, first: int, last: int, least: int, count: str = "") -> str:
    """An aggregate over the rows from ``first`` to ``last`` before the current one."""
    w = f"over (partition by symbol order by date rows between {first} preceding and {'current row' if last == 0 else f'{last} preceding'})"
    return f"(case when count({count or x}) {w} >= {least} then {agg if '(' in agg else f'{agg}({x})'} {w} end)"


def past(agg: str, x: str, n: int, least: int, skip: int = 0) -> str:
    return over(agg, x, n + skip, 1 + skip, least)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over {O}"


def change(x: str, n: int, k: int = 1) -> str:
    return f"({lag(x, k)} - {lag(x, k + n)})"


def growth(x: str, n: int, k: int = 1) -> str:
    return f"({lag(x, k)} / nullif({lag(x, k + n)}, 0) - 1)"


def score(x: str, n: int, least: int) -> str:
    return f"(({lag(x)} - {past('avg', x, n, least)}) / nullif({past('stddev_samp', x, n, least)}, 0))"


def trend(n: int) -> str:
    return f"(abs({past('avg', RET, n, n // 2)}) / nullif({past('stddev_samp', RET, n, n // 2)}, 0))"


def reversion() -> dict[str, str]:
    out = {"rev_10d": f"-{past('sum', RET, 10, 5)}"}
    for n in (20, 60):
        out |= {f"ret_zscore_{n}d": score(RET, n, n // 2), f"dist_from_mean_{n}d": f"({lag(RET)} - {past('avg', RET, n, n // 2)})"}
    return out | {"trend_60d": trend(60)}


DEFAULT = {f"ret_lag{k}": lag(RET, k) for k in (1, 2, 3, 5)}
for _n in (5, 10, 20):
    DEFAULT |= {f"roll_mean{_n}": over("avg", RET, _n - 1, 0, _n), f"roll_std{_n}": over("stddev_samp", RET, _n - 1, 0, _n)}
VOL = {"gk_vol": "gk"} | {f"har_vol_{n}d": past("avg", "gk", n, 1) for n in (1, 5, 22)} | {f"rv_trail_{n}d": past("stddev_samp", "gk", n, 1) for n in (10, 63)}
MOM = {f"mom_{n}d": past("sum", RET, n, k) for n, k in ((21, 10), (63, 30), (126, 60), (252, 120))}
MOM |= {"mom_accel": f"({MOM['mom_63d']} - {past('sum', RET, 63, 30, 21)})", "rev_5d": f"-{past('sum', RET, 5, 3)}"} | reversion() | {"trend_20d": trend(20)}
MACRO = {"yc_10y2y_lag1": lag("T10Y2Y"), "yc_10y2y_change_20d": change("T10Y2Y", 20), "yc_slope_zscore_60d": score("T10Y2Y", 60, 20)}
MACRO |= {f"{n}_lag1": lag(s) for n, s in (("us_10y", "DGS10"), ("us_2y", "DGS2"), ("us_3m", "DGS3MO"), ("fedfunds", "FEDFUNDS"), ("vix_level", "VIXCLS"), ("nfci", "NFCI"))}
MACRO |= {"us_10y_change_20d": change("DGS10", 20), "fedfunds_change_60d": change("FEDFUNDS", 60), "vix_change_5d": change("VIXCLS", 5), "vix_zscore_60d": score("VIXCLS", 60, 20)}
MACRO |= {"wti_change_20d": growth("DCOILWTICO", 20), "dollar_change_20d": growth("DTWEXBGS", 20), "nfci_change_20d": change("NFCI", 20)}
MACRO |= {"claims_change_4w": f"({past('avg', 'ICSA', 4, 1)} - {past('avg', 'ICSA', 4, 1, 4)})"} | {n: n for n in ("cape", "excess_cape_yield", "div_yield", "earn_yield")}
MEDIUM = {"vol_of_vol_5d": past("stddev_samp", "gk", 5, 3), "vol_of_vol_22d": past("stddev_samp", "gk", 22, 10), "vol_dispersion": f"({past('avg', 'gk', 5, 3)} - {past('avg', 'gk', 22, 10)})"}
MEDIUM |= {"ret_momentum_63d": past("sum", RET, 63, 31), "ret_reversal_5d": past("sum", RET, 5, 5), "ret_reversal_20d": past("sum", RET, 20, 20)}
MEDIUM |= {"ret_vol_ratio_5d_20d": f"({past('stddev_samp', RET, 5, 3)} / nullif({past('stddev_samp', RET, 20, 10)}, 0))", "ret_trend_strength": trend(20), "dollar_zscore_60d": score("DTWEXBGS", 60, 20)}
RICH = MEDIUM | {"ret_kurt_20d": over("kurtosis", RET, 19, 0, 10), "ret_skew_20d": over("skewness", RET, 19, 0, 10), "ret_max_20d": over("max", RET, 19, 0, 10)}
RICH |= {f"raw_corr_{a}": "round(" + over(f"corr({RET}, {a}_ret)", "", 19, 0, 10, f"{RET} + {a}_ret") + ", 9)" for a in ("tlt", "gld")}
RICH |= {"cross_asset_dispersion_20d": past("avg", "abs(gld_ret - tlt_ret) / sqrt(2.0)", 20, 10), "equity_bond_spread_20d": past("avg", f"{RET} - tlt_ret", 20, 10)}
RICH |= {"day_of_week": "(extract(isodow from date) - 1) / 4.0", "month_of_year": "extract(month from date) / 12.0", "ret_momentum_126d": past("sum", RET, 126, 63), "ret_momentum_252d": past("sum", RET, 252, 126)}
RICH |= {"ret_autocorr_20d": over(f"corr({RET}, before)", "", 19, 1, 14, f"{RET} + before")}
LAGS = FT.PUBLISHED
EXT = {n: growth(s, 252, LAGS[s]) for n, s in (("indpro_growth_1y", "INDPRO"), ("cpi_inflation_1y", "CPIAUCSL"), ("core_pce_inflation_1y", "PCEPILFE"), ("payems_growth_1y", "PAYEMS"), ("m2_growth_1y", "M2SL"))}
EXT |= {"payems_growth_1m": growth("PAYEMS", 21, 22), "walcl_growth_4w": growth("WALCL", 20, 5), "unrate_level": lag("UNRATE", 22), "umcsent_level": lag("UMCSENT", 15), "sahm_rule_level": lag("SAHMREALTIME", 22)}
EXT |= {"unrate_change_3m": change("UNRATE", 63, 22), "umcsent_change_1m": change("UMCSENT", 21, 15), "recession_prob_lag1": lag("recession_prob"), "recession_prob_change_20d": change("recession_prob", 20)}
_even = "tlt_ret - tip_ret"
EXT |= {"breakeven_inflation_20d": past("avg", _even, 20, 10), "breakeven_inflation_60d": past("avg", _even, 60, 20), "breakeven_inflation_change_20d": f"({past('avg', _even, 20, 10)} - {past('avg', _even, 20, 10, 20)})"}
EXT |= {f"{n}_spread_20d": past("avg", f"{RET} - {a}_ret", 20, 10) for n, a in (("spy_gld", "gld"), ("vea_spy", "vea"), ("spy_tip", "tip"), ("btc_spy", "btc"))}
EXT |= {"gld_tlt_spread_20d": past("avg", "gld_ret - tlt_ret", 20, 10), "mom_21d": past("sum", RET, 21, 10), "mom_accel": f"({past('sum', RET, 21, 10)} - {past('sum', RET, 21, 10, 21)})"} | reversion()
PARTS = {"default": DEFAULT, "vol": VOL, "macro": MACRO, "medium": MEDIUM, "rich": RICH, "extended": EXT, "mom_rev": MOM}

GK = "case when open > 0 and high > 0 and low > 0 and close > 0 then sqrt(greatest(0, 0.5 * power(ln(high / low), 2) - (2 * ln(2.0) - 1) * power(ln(close / open), 2))) end"


def sql(which: str) -> str:
    groups = FT.SETS[which]
    made = {k: v for g in groups for k, v in PARTS[g].items()}
    last = {n: n for n in FT.names(which)}
    if "macro" not in groups:
        inner = f"select symbol, date, {', '.join(f'{v} as {k}' for k, v in made.items())} from (select *, {GK} as gk from daily) b"
        return f"select symbol, cast(date as varchar) as date, {', '.join(f'round({v} + 1e-9, {DIGITS}) + 0.0 as {k}' for k, v in last.items())} from ({inner}) x"
    series = ", ".join(f"last_value({s} ignore nulls) over (order by date rows between unbounded preceding and current row) as {s}" for s in FT.SERIES)
    points = ", ".join(f"max(case when series_id = '{s}' then value end) as {s}" for s in FT.SERIES)
    known = f"select date, {series} from (select date, {points} from (select series_id, date, value from market union all select null, date, null from daily) u group by date) p"
    vol = f"case when count({RET}) over w >= 10 then stddev_samp({RET}) over w end * sqrt(252.0)"
    wide = ", ".join([f"max(case when symbol = '{s}' then {RET} end) as {a}_ret" for a, s in ASSETS.items()] + [f"max(case when symbol = '{ASSETS[a]}' then vol end) as {a}_vol" for a in ("gld", "tlt")])
    others = f"select date, {wide} from (select symbol, date, {RET}, {vol} as vol from daily where symbol in ({', '.join(repr(s) for s in ASSETS.values())}) window w as (partition by symbol order by date rows between 19 preceding and current row)) o group by date"
    base = f"select b.*, k.* exclude (date), o.* exclude (date) from (select *, {GK} as gk, lag({RET}) over {O} as before from daily) b left join ({known}) k on k.date = b.date left join ({others}) o on o.date = b.date"
    made |= {f"{a}_vol_20d_lag1": lag(f"{a}_vol") for a in ("gld", "tlt")}
    first = f"select symbol, date, {', '.join(f'{v} as {k}' for k, v in made.items())} from ({base}) c"
    fill = lambda k: f"last_value({k} ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row)"
    second = [fill(k) + f" as {k}" for k in MACRO] + [k for k in made if k not in MACRO]
    if "rich" in groups:
        second += [f"{score(f'raw_corr_{a}', 60, 20)} as corr_spy_{a}_zscore_60d" for a in ("tlt", "gld")] + [f"{fill(f'raw_corr_{a}')} as corr_spy_{a}_20d" for a in ("tlt", "gld")]
    products = {"vix_x_yc_slope": "vix_zscore_60d * yc_slope_zscore_60d", "nfci_x_dollar_zscore": "nfci_lag1 * dollar_zscore_60d", "vol_disp_x_vol_of_vol": "vol_dispersion * vol_of_vol_22d"}
    products |= {"skew_x_vol_dispersion": "ret_skew_20d * vol_dispersion", "yc_slope_x_vix": "yc_slope_zscore_60d * vix_level_lag1", "momentum_x_vol": "ret_momentum_63d * gk_vol"}
    last = {n: products.get(n, n) for n in last}
    return f"select symbol, cast(date as varchar) as date, {', '.join(f'round({v} + 1e-9, {DIGITS}) + 0.0 as {k}' for k, v in last.items())} from (select symbol, date, {', '.join(second)} from ({first}) f) g"


def register(which: str, name: str) -> None:
    """Registers a set over all symbols; macro values and other assets are stand-ins from the given tables."""
    more = "macro" in FT.SETS[which]

    @query(sql(which), ("daily", "market") if more else ("daily",), name=name)
    def run(spark, sf_dir):
        x = daily(spark, sf_dir)
        got = FT.feature_set(x, which, bars.market(spark, sf_dir), ASSETS) if more else FT.feature_set(x, which)
        return got.select("symbol", d().alias("date"), *(r(F.col(n) + 1e-9, DIGITS).alias(n) for n in FT.names(which)))


for _which, _name in (
    ("default", "features_default"), ("vol", "features_vol"), ("mom_rev", "features_mom_rev"), ("vol_macro", "features_macro"),
    ("vol_medium", "features_medium"), ("vol_rich", "features_rich"), ("vol_rich_plus", "features_extended"),
):
    register(_which, _name)


@query("select series_id, cast(date as varchar) as date, lag(value, case series_id when 'DGS10' then 5 when 'NFCI' then 30 else 1 end) over (partition by series_id order by date) as known from macro", ("macro",))
def publication_lags(spark, sf_dir):
    return FT.published(bars.macro(spark, sf_dir), {"DGS10": 5, "NFCI": 30}).select("series_id", d().alias("date"), "known")
