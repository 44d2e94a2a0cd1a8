"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewheel import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def text(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>", "None"):
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


def rows(pdf, columns):
    return sorted(tuple(text(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False))


SOME = [
    "fct_market_macro", "recession_probit", "asof_join", "upsert", "normalise_prices", "normalise_macro", "calendar_reindex", "full_outer_diff", "regime_performance", "correlation_matrix",
    "source_freshness", "regime_directional_accuracy", "rolling_skew", "label_regimes", "regime_runs", "ewma", "yoy_change", "features_default", "features_mom_rev", "features_macro",
    "walk_forward_split", "bootstrap_indices", "robustness_classify", "sweep_top_k", "check_not_null", "incremental_load", "unpivot_metrics", "provenance_flag",
    "features_extended", "features_medium", "features_vol", "drop_constant_columns", "weights_fixed", "calendar_gap_report", "bootstrap_sharpe", "bootstrap_return_pairs", "paired_window_effect",
    "overlapping_windows", "ic", "calendar_align", "window_panel", "regime_boundaries_thinned", "annualised_alpha", "fct_performance_attribution", "live_bars", "load_audit", "walk_forward_backtest",
    "skill_verdict", "return_verdict", "forecast_fan", "normalise_worldbank", "check_effect", "check_excludes_warmup", "reset_tables", "export_snapshot",
    "ensure_schema", "performance_table", "robustness_aggregate", "overall_verdict", "qlike_skill_ratio",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    expected = con.execute(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_every_query_has_columns(spark):
    assert len(plans.QUERIES) > 150
    for name in ("weights_equal", "ml_regime_returns", "features_extended"):
        assert plans.QUERIES[name](spark, SF).columns
