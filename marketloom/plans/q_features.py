"""Queries of the feature library with their oracle expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.features import REGISTRY
from marketloom.operators import research, rolling
from marketloom.plans import views as V
from marketloom.schemas import HOUR

LINE = "PARTITION BY instrument_id ORDER BY event_time_ns, seq"


def R(agg: str, n: int) -> str:
    return f"{agg} OVER ({LINE} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def P(agg: str, n: int) -> str:
    return f"{agg} OVER ({LINE} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({LINE})"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN {R(f'count({x})', n)} >= {n} THEN {R(f'{agg}({x})', n)} END"


def prior(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN {P(f'count({x})', n)} >= {n} THEN {P(f'{agg}({x})', n)} END"


def z(x: str, n: int) -> str:
    """Population z-score: 0 for a flat window."""
    m, s = full("avg", x, n), full("stddev_pop", x, n)
    return f"CASE WHEN ({s}) = 0 THEN CASE WHEN {x} = ({m}) THEN 0.0 END ELSE ({x} - ({m})) / ({s}) END"


E = "1e-12"
#: Added before rounding, so that values half-way between two results round alike in both engines.
NUDGE = 1e-10
RANGE = f"greatest(high - low, {E})"
EXPR = {
    **{f"rolling_{k}": full(a, "close", 20) for k, a in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))},
    "rolling_volume_sum": full("sum", "volume", 20),
    "simple_return": f"close / {lag('close')} - 1",
    "log_return": f"ln(close / {lag('close')})",
    "realized_volatility": full("stddev_samp", "log_return", 20),
    "return_5": f"CASE WHEN abs({lag('close', 5)}) >= {E} THEN close / {lag('close', 5)} - 1 END",
    "momentum_5": f"close - {lag('close', 5)}",
    "pv_": "close * volume",
    "vwap_20": f"({full('sum', 'pv_', 20)}) / nullif({R('sum(volume)', 20)}, 0)",
    "vwap_distance": f"close / greatest(vwap_20, {E}) - 1 + 0 * vwap_20",
    "rolling_range": "high - low",
    "candle_body_ratio": f"abs(close - open) / {RANGE}",
    "upper_shadow_ratio": f"(high - greatest(open, close)) / {RANGE}",
    "lower_shadow_ratio": f"(least(open, close) - low) / {RANGE}",
    "price_position": f"CASE WHEN {R('count(*)', 20)} >= 20 THEN (close - {R('min(low)', 20)}) / greatest({R('max(high)', 20)} - {R('min(low)', 20)}, {E}) END",
    "drawdown_from_rolling_high": f"CASE WHEN {R('count(*)', 20)} >= 20 THEN close / greatest({R('max(close)', 20)}, {E}) - 1 END",
    "breakout_up": f"close > ({prior('max', 'high', 20)})",
    "breakout_down": f"close < ({prior('min', 'low', 20)})",
    "true_range": f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))",
    "atr": full("avg", "true_range", 14),
    "volatility_ratio": f"({full('stddev_samp', 'log_return', 5)}) / (CASE WHEN {R('count(log_return)', 20)} >= 20 THEN greatest({R('stddev_samp(log_return)', 20)}, {E}) END)",
    "bollinger_width": f"CASE WHEN rolling_mean IS NOT NULL THEN 4 * rolling_std / greatest(rolling_mean, {E}) END",
    "bollinger_percent_b": f"CASE WHEN rolling_mean IS NOT NULL THEN (close - (rolling_mean - 2 * rolling_std)) / greatest(4 * rolling_std, {E}) END",
    "zscore": f"CASE WHEN rolling_mean IS NOT NULL THEN (close - rolling_mean) / greatest(rolling_std, {E}) END",
    "volume_zscore": f"CASE WHEN {R('count(*)', 20)} >= 20 THEN (volume - {R('avg(volume)', 20)}) / greatest({R('stddev_samp(volume)', 20)}, {E}) END",
    "volume_ratio": f"CASE WHEN {R('count(*)', 20)} >= 20 THEN volume / greatest({R('avg(volume)', 20)}, {E}) END",
    "bar_quote_volume": "coalesce(quote_volume, close * volume)",
    "derived_ratio": "rolling_mean / nullif(rolling_max, 0)",
    "derived_difference": "rolling_max - rolling_min",
    "derived_sum": "rolling_max + rolling_min",
    "derived_product": "rolling_mean * volume_ratio",
    "derived_rolling_std": full("stddev_samp", "rolling_mean", 10),
    "feat_sma_20": full("avg", "close", 20),
    "feat_vol_30": f"({full('stddev_samp', 'log_return', 30)}) * sqrt(252)",
    "rv_": "simple_return * volume",
    "feat_vwm_20": f"({full('sum', 'rv_', 20)}) / nullif({R('sum(volume)', 20)}, 0)",
    "feat_vwm_zscore_60": f"CASE WHEN ({full('stddev_samp', 'feat_vwm_20', 60)}) > 0 THEN (feat_vwm_20 - ({full('avg', 'feat_vwm_20', 60)})) / ({full('stddev_samp', 'feat_vwm_20', 60)}) END",
    "trade_volume_sum": full("sum", "quantity", 50),
    "avg_trade_size": full("avg", "quantity", 50),
    "pq_": "price * quantity",
    "trade_quote_volume_sum": full("sum", "pq_", 50),
    "trade_vwap": f"({full('sum', 'pq_', 50)}) / nullif({R('sum(quantity)', 50)}, 0)",
    "signed_": "CASE side WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity END",
    "signed_trade_volume": full("sum", "signed_", 50),
    "trade_imbalance": f"CASE WHEN {R('count(signed_)', 50)} >= 50 THEN {R('sum(signed_)', 50)} / greatest({R('sum(abs(signed_))', 50)}, {E}) END",
    "is_large_": "(quantity >= 50)::INT::DOUBLE",
    "large_trade_ratio": full("avg", "is_large_", 50),
    "mid_price": "(bid_price + ask_price) / 2",
    "spread": "ask_price - bid_price",
    "book_imbalance": "(bid_size - ask_size) / nullif(bid_size + ask_size, 0)",
    # research matrix
    **{f"f_return_{n}": f"close / nullif({lag('close', n)}, 0) - 1" for n in (1, 3, 5, 15, 30)},
    **{f"f_rolling_vol_{n}": full("stddev_pop", "f_return_1", n) for n in (30, 60)},
    "f_tr_": f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END",
    "f_atr_pct_30": f"({full('avg', 'f_tr_', 30)}) / nullif(close, 0)",
    **{f"f_ma_distance_{n}": f"close / nullif({full('avg', 'close', n)}, 0) - 1" for n in (30, 120)},
    **{f"f_trend_slope_{n}": f"CASE WHEN {R('count(*)', n)} >= {n} THEN {R('regr_slope(close, rn_)', n)} / nullif(close, 0) END" for n in (30, 120)},
    "f_donchian_high_dist_60": f"close / nullif({full('max', 'high', 60)}, 0) - 1",
    "f_donchian_low_dist_60": f"close / nullif({full('min', 'low', 60)}, 0) - 1",
    "f_bollinger_z_60": z("close", 60),
    "f_volume_z_60": z("volume", 60),
    "f_high_low_range_pct": "(high - low) / nullif(close, 0)",
    "f_candle_body_pct": "(close - open) / nullif(close, 0)",
    "f_time_of_day_sin": "sin(2 * pi() * ((event_time_ns // 60000000000) % 1440) / 1440)",
    "f_time_of_day_cos": "cos(2 * pi() * ((event_time_ns // 60000000000) % 1440) / 1440)",
    "f2_return_accel_5_15": "f_return_5 - f_return_15",
    "f2_up_": "CASE WHEN f_return_1 > 0 THEN f_return_1 * f_return_1 WHEN f_return_1 IS NOT NULL THEN 0.0 END",
    "f2_down_": "CASE WHEN f_return_1 < 0 THEN f_return_1 * f_return_1 WHEN f_return_1 IS NOT NULL THEN 0.0 END",
    "f2_upside_vol_30": f"sqrt({full('avg', 'f2_up_', 30)})",
    "f2_downside_vol_30": f"sqrt({full('avg', 'f2_down_', 30)})",
    "f2_signed_vol_ratio_30": f"(f2_upside_vol_30 - f2_downside_vol_30) / (f2_upside_vol_30 + f2_downside_vol_30 + {E})",
    "f2_clv": f"((close - low) - (high - close)) / ((high - low) + {E})",
    "f2_atr_30_": full("avg", "f_tr_", 30),
    "f2_breakout_strength_high_60": f"(close - ({full('max', 'high', 60)})) / (f2_atr_30_ + {E})",
    "f2_breakout_strength_low_60": f"(({full('min', 'low', 60)}) - close) / (f2_atr_30_ + {E})",
    "f2_sign_": f"sign(close - {lag('close')})::DOUBLE",
    "f2_trend_consistency_30": full("avg", "f2_sign_", 30),
    "f2_up_break_": f"CASE WHEN close > {lag('close')} THEN NULL ELSE rn_ END",
    "f2_down_break_": f"CASE WHEN close < {lag('close')} THEN NULL ELSE rn_ END",
    "f2_consecutive_up_bars": f"least(coalesce(rn_ - {R('max(f2_up_break_)', 31)}, 30), 30) / 30.0::DOUBLE",
    "f2_consecutive_down_bars": f"least(coalesce(rn_ - {R('max(f2_down_break_)', 31)}, 30), 30) / 30.0::DOUBLE",
    "f2_pullback_from_high_60": f"close / nullif({full('max', 'high', 60)}, 0) - 1",
    "f2_rebound_from_low_60": f"close / nullif({full('min', 'low', 60)}, 0) - 1",
    "f2_taker_buy_volume_ratio": "taker_buy_volume / nullif(volume, 0)",
    "f2_taker_buy_quote_ratio": "taker_buy_quote_volume / nullif(quote_volume, 0)",
    "f2_taker_imbalance": "2 * f2_taker_buy_volume_ratio - 1",
    "f2_taker_quote_imbalance": "2 * f2_taker_buy_quote_ratio - 1",
    **{f"f2_taker_imbalance_{n}": full("avg", "f2_taker_imbalance", n) for n in (5, 15, 30)},
    "f2_taker_imbalance_momentum_5_30": "f2_taker_imbalance_5 - f2_taker_imbalance_30",
    "f2_signed_quote_volume": "quote_volume * f2_taker_quote_imbalance",
    "f2_signed_quote_volume_z_30": z("f2_signed_quote_volume", 30),
    "f2_trade_count_z_30": z("trade_count", 30),
    "f2_avg_trade_size": "volume / nullif(trade_count, 0)",
    "f2_avg_trade_size_z_30": z("f2_avg_trade_size", 30),
    "f2_quote_volume_z_": z("quote_volume", 30),
    "f2_large_activity_proxy": "f2_quote_volume_z_ + f2_trade_count_z_30",
    "f2_orderflow_price_confirm_15": "sign(f_return_15) * f2_taker_imbalance_15",
    "f2_trend_flow_confirm_30": "sign(f_trend_slope_30) * f2_taker_imbalance_30",
    "f2_vol_regime_60": z("f_rolling_vol_60", 60),
    "f2_time_vol_interaction": "f_time_of_day_sin * f_rolling_vol_60",
    "rn_": f"row_number() OVER ({LINE})",
}

VIEW = {"bars": (V.bars, "v_bars"), "trades": (V.trades, "v_trades"), "quotes": (V.quotes, "v_quotes"), "research": (V.bars, "v_bars")}
KEYS = ("instrument_id", "event_time_ns", "seq")


def feature_sql(names: list[str], view: str, outs: dict[str, str] | None = None) -> str:
    """One CTE for each level of what the features build on; values rounded to 6 places."""
    ctes, last = [V.sql(view)], view
    if any("rn_" in EXPR[n] for level in REGISTRY.levels(names) for n in level):
        ctes.append(f"numbered AS (SELECT *, {EXPR['rn_']} AS rn_ FROM {last})")
        last = "numbered"
    for k, level in enumerate(REGISTRY.levels(names)):
        made = ", ".join(f"{EXPR[n]} AS {n}" for n in level if n != "rn_")
        if made:
            ctes.append(f"l{k} AS (SELECT *, {made} FROM {last})")
            last = f"l{k}"
    picked = ", ".join(n if n.startswith("breakout") else f"round({n} + {NUDGE}, 6) AS {n}" for n in names)
    return f"WITH {', '.join(ctes)} SELECT {', '.join(KEYS)}, {picked} FROM {last}"


def rounded(df, names):
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *(F.col(n) if kinds[n] == "boolean" else F.round(F.col(n).cast("double") + NUDGE, 6).alias(n) for n in names))


def _feature_query(names: list[str], group: str):
    view, name = VIEW[group]

    def run(spark, sf_dir):
        return rounded(REGISTRY.compute(view(spark, sf_dir), names), names)

    return run, feature_sql(names, name)


QUERIES, ORACLES = {}, {}
for _f in list(REGISTRY.known.values()):
    if not _f.name.endswith("_") and _f.name in EXPR and not _f.name.startswith("ind_"):
        QUERIES[_f.name], ORACLES[_f.name] = _feature_query([_f.name], _f.group)
QUERIES["quote_volume"], ORACLES["quote_volume"] = QUERIES.pop("bar_quote_volume"), ORACLES.pop("bar_quote_volume")
for _name, _names in (("research_matrix_v1", research.V1), ("research_matrix_v2", [*research.V1, *research.V2])):
    QUERIES[_name], ORACLES[_name] = _feature_query(_names, "research")


def _time_windows(spark, sf_dir):
    made = {"n": ("count", F.lit(1)), "total": ("sum", F.col("quantity")), "mean": ("avg", F.col("price"))}
    t = rolling.in_time(V.trades(spark, sf_dir), HOUR, made)
    return t.select(*KEYS, "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


_RANGE = f"OVER (PARTITION BY instrument_id ORDER BY event_time_ns RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)"
QUERIES["rolling_time_window"] = _time_windows
ORACLES["rolling_time_window"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, event_time_ns, seq, count(*) {_RANGE} AS n, round(sum(quantity) {_RANGE}, 6) AS total, round(avg(price) {_RANGE}, 6) AS mean FROM v_trades"


def _trade_count(spark, sf_dir):
    return rolling.in_time(V.trades(spark, sf_dir), HOUR, {"trade_count": ("count", F.lit(1))}).select(*KEYS, "trade_count")


QUERIES["trade_count"] = _trade_count
ORACLES["trade_count"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, event_time_ns, seq, count(*) {_RANGE} AS trade_count FROM v_trades"
QUERIES["trade_intensity"] = lambda spark, sf_dir: _trade_count(spark, sf_dir).select(*KEYS, F.round(F.col("trade_count") / 3600.0, 9).alias("trade_intensity"))
ORACLES["trade_intensity"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, event_time_ns, seq, round(count(*) {_RANGE} / 3600.0::DOUBLE, 9) AS trade_intensity FROM v_trades"
QUERIES["vwap"] = lambda spark, sf_dir: rolling.session_vwap(V.bars(spark, sf_dir)).select(*KEYS, F.round("session_vwap", 6).alias("session_vwap"))
_DAY = "OVER (PARTITION BY instrument_id, event_time_ns // 86400000000000 ORDER BY event_time_ns, seq ROWS UNBOUNDED PRECEDING)"
ORACLES["vwap"] = f"WITH {V.sql('v_bars')} SELECT instrument_id, event_time_ns, seq, round(sum(close * volume) {_DAY} / nullif(sum(volume) {_DAY}, 0), 6) AS session_vwap FROM v_bars"
QUERIES["trigger_policy"] = lambda spark, sf_dir: rolling.triggered(V.trades(spark, sf_dir), "every_n", 10).select(*KEYS, "price")
ORACLES["trigger_policy"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, event_time_ns, seq, price FROM (SELECT *, row_number() OVER ({LINE}) AS k FROM v_trades) WHERE k % 10 = 0"


def _reset(spark, sf_dir):
    return rounded(REGISTRY.compute(V.bars(spark, sf_dir), ["simple_return", "momentum_5"], reset="trading_date"), ["simple_return", "momentum_5"])


_DLINE = "OVER (PARTITION BY instrument_id, event_time_ns // 86400000000000 ORDER BY event_time_ns, seq)"
QUERIES["feat_cross_day_reset"] = _reset
ORACLES["feat_cross_day_reset"] = f"WITH {V.sql('v_bars')} SELECT instrument_id, event_time_ns, seq, round(close / lag(close) {_DLINE} - 1, 6) AS simple_return, round(close - lag(close, 5) {_DLINE}, 6) AS momentum_5 FROM v_bars"
_DAG = ["feat_sma_20", "feat_vol_30", "feat_vwm_20", "feat_vwm_zscore_60", "derived_rolling_std"]
QUERIES["feat_dag"], ORACLES["feat_dag"] = _feature_query(_DAG, "bars")
