"""The feature library over bars, trades and quotes: rolling statistics, price action, volume,
volatility, order flow. Null until a window is full; deviations are of samples here."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.functions.features import REGISTRY, Line
from marketloom.operators import scan
from marketloom.schemas import EPS, KEY

def _c(name: str) -> Column:
    return F.col(name)


def at_least(x: Column, least: float = EPS) -> Column:
    return F.when(x < least, least).otherwise(x)  # a null stays null


def _add(name, fn, deps=(), lookback=0, inputs=("close",), group="bars"):
    REGISTRY.add(name, fn, deps, lookback, inputs, group)


N = 20
for _name, _agg in (("mean", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max), ("std", F.stddev_samp)):
    _add(f"rolling_{_name}", lambda w, a=_agg: w.full(N, a("close"), "close"), lookback=N - 1)
_add("rolling_volume_sum", lambda w: w.full(N, F.sum("volume"), "volume"), lookback=N - 1, inputs=("volume",))
_add("simple_return", lambda w: _c("close") / w.lag("close") - 1, lookback=1)
_add("log_return", lambda w: F.log(_c("close") / w.lag("close")), lookback=1)
_add("realized_volatility", lambda w: w.full(N, F.stddev_samp("log_return"), "log_return"), ("log_return",), N - 1)
for _n in (5, 10, 30):
    _add(f"return_{_n}", lambda w, n=_n: F.when(F.abs(w.lag("close", n)) >= EPS, _c("close") / w.lag("close", n) - 1), lookback=_n)
    _add(f"momentum_{_n}", lambda w, n=_n: _c("close") - w.lag("close", n), lookback=_n)
_add("vwap_20", lambda w: w.full(N, F.sum("pv_"), "pv_") / F.nullif(w.full(N, F.sum("volume"), "volume"), F.lit(0.0)), ("pv_",), N - 1, ("close", "volume"))
_add("pv_", lambda w: _c("close") * _c("volume"), inputs=("close", "volume"))
_add("vwap_distance", lambda w: _c("close") / at_least(_c("vwap_20")) - 1, ("vwap_20",))
# price action
_add("rolling_range", lambda w: _c("high") - _c("low"), inputs=("high", "low"))
_add("candle_body_ratio", lambda w: F.abs(_c("close") - _c("open")) / at_least(_c("high") - _c("low")), inputs=("open", "high", "low", "close"))
_add("upper_shadow_ratio", lambda w: (_c("high") - F.greatest("open", "close")) / at_least(_c("high") - _c("low")), inputs=("open", "high", "low", "close"))
_add("lower_shadow_ratio", lambda w: (F.least("open", "close") - _c("low")) / at_least(_c("high") - _c("low")), inputs=("open", "high", "low", "close"))


def _position(w: Line) -> Column:
    low, high = w.full(N, F.min("low"), "low"), w.full(N, F.max("high"), "high")
    return (_c("close") - low) / at_least(high - low)


_add("price_position", _position, lookback=N - 1, inputs=("high", "low", "close"))
_add("drawdown_from_rolling_high", lambda w: _c("close") / at_least(w.full(N, F.max("close"), "close")) - 1, lookback=N - 1)
_add("breakout_up", lambda w: _c("close") > w.full_prior(N, F.max("high"), "high"), lookback=N, inputs=("high", "close"))
_add("breakout_down", lambda w: _c("close") < w.full_prior(N, F.min("low"), "low"), lookback=N, inputs=("low", "close"))
# volatility
_add(
    "true_range",
    lambda w: F.greatest(_c("high") - _c("low"), F.coalesce(F.abs(_c("high") - w.lag("close")), F.lit(0.0)), F.coalesce(F.abs(_c("low") - w.lag("close")), F.lit(0.0))),
    lookback=1,
    inputs=("high", "low", "close"),
)
_add("atr", lambda w: w.full(14, F.avg("true_range"), "true_range"), ("true_range",), 13)
_add("volatility_ratio", lambda w: w.full(5, F.stddev_samp("log_return"), "log_return") / at_least(w.full(20, F.stddev_samp("log_return"), "log_return")), ("log_return",), 19)
_add("bollinger_width", lambda w: 4 * _c("rolling_std") / at_least(_c("rolling_mean")), ("rolling_mean", "rolling_std"))
_add("bollinger_percent_b", lambda w: (_c("close") - (_c("rolling_mean") - 2 * _c("rolling_std"))) / at_least(4 * _c("rolling_std")), ("rolling_mean", "rolling_std"))
_add("zscore", lambda w: (_c("close") - _c("rolling_mean")) / at_least(_c("rolling_std")), ("rolling_mean", "rolling_std"))
# volume
_add("volume_zscore", lambda w: (_c("volume") - w.full(N, F.avg("volume"), "volume")) / at_least(w.full(N, F.stddev_samp("volume"), "volume")), lookback=N - 1, inputs=("volume",))
_add("volume_ratio", lambda w: _c("volume") / at_least(w.full(N, F.avg("volume"), "volume")), lookback=N - 1, inputs=("volume",))
_add("bar_quote_volume", lambda w: F.coalesce(_c("quote_volume"), _c("close") * _c("volume")), inputs=("close", "volume", "quote_volume"))
# features of features
_add("derived_ratio", lambda w: _c("rolling_mean") / F.nullif(_c("rolling_max"), F.lit(0.0)), ("rolling_mean", "rolling_max"))
_add("derived_difference", lambda w: _c("rolling_max") - _c("rolling_min"), ("rolling_max", "rolling_min"))
_add("derived_sum", lambda w: _c("rolling_max") + _c("rolling_min"), ("rolling_max", "rolling_min"))
_add("derived_product", lambda w: _c("rolling_mean") * _c("volume_ratio"), ("rolling_mean", "volume_ratio"))
_add("derived_rolling_std", lambda w: w.full(10, F.stddev_samp("rolling_mean"), "rolling_mean"), ("rolling_mean",), 9)
# the registered batch and stream features
_add("feat_sma_20", lambda w: w.full(20, F.avg("close"), "close"), lookback=19)
_add("feat_vol_30", lambda w: w.full(30, F.stddev_samp("log_return"), "log_return") * sqrt(252), ("log_return",), 29)
_add("feat_vwm_20", lambda w: w.full(20, F.sum("rv_"), "rv_") / F.nullif(w.full(20, F.sum("volume"), "rv_"), F.lit(0.0)), ("rv_",), 19, ("volume",))
_add("rv_", lambda w: _c("simple_return") * _c("volume"), ("simple_return",), inputs=("volume",))
_add(
    "feat_vwm_zscore_60",
    lambda w: F.when(w.full(60, F.stddev_samp("feat_vwm_20"), "feat_vwm_20") > 0, (_c("feat_vwm_20") - w.full(60, F.avg("feat_vwm_20"), "feat_vwm_20")) / w.full(60, F.stddev_samp("feat_vwm_20"), "feat_vwm_20")),
    ("feat_vwm_20",),
    59,
)
# recursions
for _n in (12, 26):
    REGISTRY.add_ema(f"ewma_{_n}", "close", _n, inputs=("close",), group="bars")
_add("ewma_gap", lambda w: _c("ewma_12") - _c("ewma_26"), ("ewma_12", "ewma_26"))
REGISTRY.add_ema("ewma_signal", "ewma_gap", 9, ("ewma_gap",), group="bars")
_add("ewma_swing", lambda w: w.full(10, F.max("ewma_signal"), "ewma_signal") - w.full(10, F.min("ewma_signal"), "ewma_signal"), ("ewma_signal",), 9)
REGISTRY.add_ema("ewma_price", "price", 10, inputs=("price",), group="trades")
_add("ewma_price_gap", lambda w: _c("price") / at_least(_c("ewma_price")) - 1, ("ewma_price",), inputs=("price",), group="trades")
# trades
T = 50
for _name, _dep in (("trade_volume_sum", F.sum), ("avg_trade_size", F.avg)):
    _add(_name, lambda w, a=_dep: w.full(T, a("quantity"), "quantity"), lookback=T - 1, inputs=("quantity",), group="trades")
_add("pq_", lambda w: _c("price") * _c("quantity"), inputs=("price", "quantity"), group="trades")
_add("trade_quote_volume_sum", lambda w: w.full(T, F.sum("pq_"), "pq_"), ("pq_",), T - 1, (), "trades")
_add("trade_vwap", lambda w: w.full(T, F.sum("pq_"), "pq_") / F.nullif(w.full(T, F.sum("quantity"), "pq_"), F.lit(0.0)), ("pq_",), T - 1, ("quantity",), "trades")
_add("signed_", lambda w: F.when(_c("side") == "BUY", _c("quantity")).when(_c("side") == "SELL", -_c("quantity")), inputs=("side", "quantity"), group="trades")
_add("signed_trade_volume", lambda w: w.full(T, F.sum("signed_"), "signed_"), ("signed_",), T - 1, (), "trades")
_add("trade_imbalance", lambda w: w.full(T, F.sum("signed_"), "signed_") / at_least(w.full(T, F.sum(F.abs("signed_")), "signed_")), ("signed_",), T - 1, (), "trades")
_add("is_large_", lambda w: (_c("quantity") >= 50).cast("double"), inputs=("quantity",), group="trades")
_add("large_trade_ratio", lambda w: w.full(T, F.avg("is_large_"), "is_large_"), ("is_large_",), T - 1, (), "trades")
# quotes
_add("mid_price", lambda w: (_c("bid_price") + _c("ask_price")) / 2, inputs=("bid_price", "ask_price"), group="quotes")
_add("spread", lambda w: _c("ask_price") - _c("bid_price"), inputs=("bid_price", "ask_price"), group="quotes")
_add("book_imbalance", lambda w: (_c("bid_size") - _c("ask_size")) / F.nullif(_c("bid_size") + _c("ask_size"), F.lit(0.0)), inputs=("bid_size", "ask_size"), group="quotes")


def in_time(df: DataFrame, span: int, made: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with aggregates over the last `span` nanoseconds, (t - span, t]; made: name to "count", "sum"
    or "avg" and a number, which is taken as a double.

    Time is cut into cells of `span`. A window is the head of its own cell and the tail of the cell
    before: a running total of the cell's rows forward in time, and one of copies of the earlier
    rows backward from the time at which they leave. So work is linear in the rows, however many
    share a window, and nothing is subtracted.
    """
    parts = {}  # what is totalled: name to aggregate and number
    for name, (how, value) in made.items():
        parts[f"{name}_n"] = F.count, value
        if how != "count":
            # in parts of 10^-12, so that the order of summing doesn't matter; what they can't hold is summed as it is
            x = value.cast("double")
            exact = x.try_cast("decimal(27,12)")
            fits = F.coalesce(F.abs(exact.cast("double") - x) <= F.abs(x) * 2.0**-50, F.lit(False))
            parts |= {f"{name}_e": (F.sum, F.when(fits, exact)), f"{name}_r": (F.sum, F.when(~fits, x))}
    rows = scan.time_halo(df, span, span).withColumn("at_", F.col("event_time_ns") + F.when(F.col("home_"), 0).otherwise(span))
    cell = Window.partitionBy(KEY, "block_")
    head = cell.orderBy("at_").rangeBetween(Window.unboundedPreceding, 0)
    tail = cell.orderBy(F.desc("at_")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{k}h": agg(F.when(F.col("home_"), x)).over(head) for k, (agg, x) in parts.items()})
    rows = rows.withColumns({f"{k}t": agg(F.when(~F.col("home_"), x)).over(tail) for k, (agg, x) in parts.items()})
    both = {k: F.coalesce(F.col(f"{k}h") + F.col(f"{k}t"), f"{k}h", f"{k}t") for k in parts}
    outs = {}
    for name, (how, _) in made.items():
        outs[name] = n = both[f"{name}_n"]
        if how != "count":
            exact, rest = both[f"{name}_e"], both[f"{name}_r"]
            total = F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
            # a mean of at most 12 decimals, such as a half-way one, is taken as it is: the quotient of doubles can miss it
            short = (exact / n).try_cast("decimal(27,12)")
            whole = rest.isNull() & (short * n.try_cast("decimal(10,0)") == exact)
            mean = F.when(whole, short.cast("double")).otherwise(total / n)
            outs[name] = F.when(n > 0, mean if how == "avg" else total)
    return scan.home(rows.withColumns(outs)).drop("at_", *(f"{k}{x}" for k in parts for x in "ht"))


def session_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted price since the start of each UTC day; null while there is no volume."""
    from marketloom.operators.bars import trading_date

    line = Window.partitionBy(KEY, "day_").orderBy("event_time_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("day_", trading_date())
    total = F.sum(_c("close") * _c("volume")).over(line) / F.nullif(F.sum("volume").over(line), F.lit(0.0))
    return out.withColumn("session_vwap", total).drop("day_")


def triggered(df: DataFrame, policy: str, n: int = 10, interval: int = 3600 * 10**9) -> DataFrame:
    """Rows at which features are to be emitted: on_event, every_n, or on_interval (the first row
    of each interval)."""
    if policy == "on_event":
        return df
    if policy == "every_n":
        return scan.numbered(df).where((F.col("ord_") + 1) % n == 0).drop("ord_")
    if policy == "on_interval":
        spans = df.withColumn("span_", idiv(F.col("event_time_ns"), interval))
        line = Window.partitionBy(KEY, "span_").orderBy("event_time_ns", "seq")
        return spans.withColumn("at_", F.row_number().over(line)).where("at_ = 1").drop("at_", "span_")
    raise ValueError(f"unknown policy {policy!r}")
