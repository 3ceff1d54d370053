"""Registered queries against DuckDB: one of each kind of plan (the driver runs them all)."""

import pytest

from marketloom.plans import registry
from tests.oracle import DATA, same

CHOSEN = (
    "feat_sma_20 realized_volatility breakout_up trade_imbalance rolling_time_window vwap research_matrix_v2 feat_cross_day_reset feat_rsi_14 feat_macd ind_pressure ind_amat ind_swings ind_rsi "
    "ind_fuzzy_candles bars_time bars_volume bars_tick_imbalance bars_value_runs bars_renko bars_fill_empty spread_quotes join_asof_backward join_asof_forward_label join_interest_rate labels_3class "
    "split_purge dataset_v1 stat_max_drawdown ev_trade_pnl_stats ev_rank book_px_for_exposure option_strike_select sig_trend_breakout_atr src_exchange_klines src_exchange_aggtrades src_schema_infer sink_hive catalog_missing_intervals validate_bars stream_features stream_watermark stream_stateful_containers stream_late_policy stream_bars sig_vwm_short ingest_canonicalize return_n momentum_n ml_threshold_analysis ml_top_pct ml_top_pct_stats ml_compare ml_best_threshold ml_eval ml_confusion latency_stats feature_store_query feature_latest feature_window"
).split()


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, name):
    same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


def test_every_query_with_sql_has_the_same_key():
    assert set(registry.oracle_sql()) <= set(registry.queries())
