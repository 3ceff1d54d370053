"""The research feature matrix: population deviations, null until a window is full; a flat window
has z-score 0. Version 1 reads prices and volume, version 2 adds order flow."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.functions.features import REGISTRY, Line
from marketloom.schemas import EPS, MINUTE


def _c(name: str) -> Column:
    return F.col(name)


def _zero_null(x) -> Column:
    return F.nullif(x, F.lit(0.0))


def zscore(w: Line, x: str, n: int) -> Column:
    m, s = w.full(n, F.avg(x), x), w.full(n, F.stddev_pop(x), x)
    return F.when(s == 0, F.when(_c(x) == m, 0.0)).otherwise((_c(x) - m) / s)


V1: list[str] = []
V2: list[str] = []


def _add(into: list[str], name, fn, deps=(), lookback=0, inputs=("close",)):
    REGISTRY.add(name, fn, deps, lookback, inputs, "research")
    if not name.endswith("_"):
        into.append(name)


for _n in (1, 3, 5, 15, 30):
    _add(V1, f"f_return_{_n}", lambda w, n=_n: _c("close") / _zero_null(w.lag("close", n)) - 1, lookback=_n)
for _n in (30, 60):
    _add(V1, f"f_rolling_vol_{_n}", lambda w, n=_n: w.full(n, F.stddev_pop("f_return_1"), "f_return_1"), ("f_return_1",), _n - 1)


def _true_range(w: Line) -> Column:
    before = w.lag("close")
    return F.when(before.isNotNull(), F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before)))


_add(V1, "f_tr_", _true_range, lookback=1, inputs=("high", "low", "close"))
_add(V1, "f_atr_pct_30", lambda w: w.full(30, F.avg("f_tr_"), "f_tr_") / _zero_null(_c("close")), ("f_tr_",), 29)
for _n in (30, 120):
    _add(V1, f"f_ma_distance_{_n}", lambda w, n=_n: _c("close") / _zero_null(w.full(n, F.avg("close"), "close")) - 1, lookback=_n - 1)
_add(V1, "rn_", lambda w: F.row_number().over(w.base), inputs=())
for _n in (30, 120):
    _add(V1, f"f_trend_slope_{_n}", lambda w, n=_n: w.full(n, F.regr_slope("close", "rn_"), "close") / _zero_null(_c("close")), ("rn_",), _n - 1)
_add(V1, "f_donchian_high_dist_60", lambda w: _c("close") / _zero_null(w.full(60, F.max("high"), "high")) - 1, lookback=59, inputs=("high", "close"))
_add(V1, "f_donchian_low_dist_60", lambda w: _c("close") / _zero_null(w.full(60, F.min("low"), "low")) - 1, lookback=59, inputs=("low", "close"))
_add(V1, "f_bollinger_z_60", lambda w: zscore(w, "close", 60), lookback=59)
_add(V1, "f_volume_z_60", lambda w: zscore(w, "volume", 60), lookback=59, inputs=("volume",))
_add(V1, "f_high_low_range_pct", lambda w: (_c("high") - _c("low")) / _zero_null(_c("close")), inputs=("high", "low", "close"))
_add(V1, "f_candle_body_pct", lambda w: (_c("close") - _c("open")) / _zero_null(_c("close")), inputs=("open", "close"))
_angle = lambda: F.pmod(idiv(_c("event_time_ns"), MINUTE), F.lit(1440)) * (2 * pi) / 1440
_add(V1, "f_time_of_day_sin", lambda w: F.sin(_angle()), inputs=())
_add(V1, "f_time_of_day_cos", lambda w: F.cos(_angle()), inputs=())

_add(V2, "f2_return_accel_5_15", lambda w: _c("f_return_5") - _c("f_return_15"), ("f_return_5", "f_return_15"))
for _name, _sign in (("up", 1), ("down", -1)):
    _add(V2, f"f2_{_name}_", lambda w, s=_sign: F.when(_c("f_return_1") * s > 0, _c("f_return_1") * _c("f_return_1")).when(_c("f_return_1").isNotNull(), 0.0), ("f_return_1",))
    _add(V2, f"f2_{_name}side_vol_30", lambda w, n=_name: F.sqrt(w.full(30, F.avg(f"f2_{n}_"), f"f2_{n}_")), (f"f2_{_name}_",), 29)
_add(
    V2,
    "f2_signed_vol_ratio_30",
    lambda w: (_c("f2_upside_vol_30") - _c("f2_downside_vol_30")) / (_c("f2_upside_vol_30") + _c("f2_downside_vol_30") + EPS),
    ("f2_upside_vol_30", "f2_downside_vol_30"),
)
_add(V2, "f2_clv", lambda w: ((_c("close") - _c("low")) - (_c("high") - _c("close"))) / (_c("high") - _c("low") + EPS), inputs=("high", "low", "close"))
_add(V2, "f2_atr_30_", lambda w: w.full(30, F.avg("f_tr_"), "f_tr_"), ("f_tr_",), 29)
_add(V2, "f2_breakout_strength_high_60", lambda w: (_c("close") - w.full(60, F.max("high"), "high")) / (_c("f2_atr_30_") + EPS), ("f2_atr_30_",), 59, ("high", "close"))
_add(V2, "f2_breakout_strength_low_60", lambda w: (w.full(60, F.min("low"), "low") - _c("close")) / (_c("f2_atr_30_") + EPS), ("f2_atr_30_",), 59, ("low", "close"))
_add(V2, "f2_sign_", lambda w: F.signum(_c("close") - w.lag("close")), lookback=1)
_add(V2, "f2_trend_consistency_30", lambda w: w.full(30, F.avg("f2_sign_"), "f2_sign_"), ("f2_sign_",), 29)
for _name, _sign in (("up", 1), ("down", -1)):
    # the last row that ends the run; the first row of a history does
    _add(V2, f"f2_{_name}_break_", lambda w, s=_sign: F.when((_c("close") - w.lag("close")) * s > 0, None).otherwise(_c("rn_")), ("rn_",), 1)
    _add(V2, f"f2_consecutive_{_name}_bars", lambda w, n=_name: F.least(F.coalesce(_c("rn_") - F.max(f"f2_{n}_break_").over(w.rows(31)), F.lit(30)), F.lit(30)) / 30.0, (f"f2_{_name}_break_",), 30)
_add(V2, "f2_pullback_from_high_60", lambda w: _c("close") / _zero_null(w.full(60, F.max("high"), "high")) - 1, lookback=59, inputs=("high", "close"))
_add(V2, "f2_rebound_from_low_60", lambda w: _c("close") / _zero_null(w.full(60, F.min("low"), "low")) - 1, lookback=59, inputs=("low", "close"))
_add(V2, "f2_taker_buy_volume_ratio", lambda w: _c("taker_buy_volume") / _zero_null(_c("volume")), inputs=("taker_buy_volume", "volume"))
_add(V2, "f2_taker_buy_quote_ratio", lambda w: _c("taker_buy_quote_volume") / _zero_null(_c("quote_volume")), inputs=("taker_buy_quote_volume", "quote_volume"))
_add(V2, "f2_taker_imbalance", lambda w: 2 * _c("f2_taker_buy_volume_ratio") - 1, ("f2_taker_buy_volume_ratio",))
_add(V2, "f2_taker_quote_imbalance", lambda w: 2 * _c("f2_taker_buy_quote_ratio") - 1, ("f2_taker_buy_quote_ratio",))
for _n in (5, 15, 30):
    _add(V2, f"f2_taker_imbalance_{_n}", lambda w, n=_n: w.full(n, F.avg("f2_taker_imbalance"), "f2_taker_imbalance"), ("f2_taker_imbalance",), _n - 1)
_add(V2, "f2_taker_imbalance_momentum_5_30", lambda w: _c("f2_taker_imbalance_5") - _c("f2_taker_imbalance_30"), ("f2_taker_imbalance_5", "f2_taker_imbalance_30"))
_add(V2, "f2_signed_quote_volume", lambda w: _c("quote_volume") * _c("f2_taker_quote_imbalance"), ("f2_taker_quote_imbalance",), inputs=("quote_volume",))
_add(V2, "f2_signed_quote_volume_z_30", lambda w: zscore(w, "f2_signed_quote_volume", 30), ("f2_signed_quote_volume",), 29)
_add(V2, "f2_trade_count_z_30", lambda w: zscore(w, "trade_count", 30), lookback=29, inputs=("trade_count",))
_add(V2, "f2_avg_trade_size", lambda w: _c("volume") / F.nullif(_c("trade_count"), F.lit(0)), inputs=("volume", "trade_count"))
_add(V2, "f2_avg_trade_size_z_30", lambda w: zscore(w, "f2_avg_trade_size", 30), ("f2_avg_trade_size",), 29)
_add(V2, "f2_quote_volume_z_", lambda w: zscore(w, "quote_volume", 30), lookback=29, inputs=("quote_volume",))
_add(V2, "f2_large_activity_proxy", lambda w: _c("f2_quote_volume_z_") + _c("f2_trade_count_z_30"), ("f2_quote_volume_z_", "f2_trade_count_z_30"))
_add(V2, "f2_orderflow_price_confirm_15", lambda w: F.signum("f_return_15") * _c("f2_taker_imbalance_15"), ("f_return_15", "f2_taker_imbalance_15"))
_add(V2, "f2_trend_flow_confirm_30", lambda w: F.signum("f_trend_slope_30") * _c("f2_taker_imbalance_30"), ("f_trend_slope_30", "f2_taker_imbalance_30"))
_add(V2, "f2_vol_regime_60", lambda w: zscore(w, "f_rolling_vol_60", 60), ("f_rolling_vol_60",), 59)
_add(V2, "f2_time_vol_interaction", lambda w: _c("f_time_of_day_sin") * _c("f_rolling_vol_60"), ("f_time_of_day_sin", "f_rolling_vol_60"))
