"""Technical indicators. Simple means emit from the first row; exponential ones start at the first
value. Windowed indicators are registry features (halo blocks); recursive ones are functions of a
bar table built on affine scans; state machines are folds."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.functions.features import REGISTRY, Line
from marketloom.operators import scan
from marketloom.schemas import DAY, KEY, ORDER


def _c(name: str) -> Column:
    return F.col(name)


def _add(name, fn, deps=(), lookback=0, inputs=("close",), group="indicators"):
    REGISTRY.add(name, fn, deps, lookback, inputs, group)


def _ready(w: Line, n: int, x: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(w.rows(n)) >= n, x)


def wma(w: Line, x: str, n: int) -> Column:
    """Linearly weighted mean, newest weight n; early rows use the weights of the newest."""
    values = [(_c(x) if k == 0 else w.lag(x, k), n - k) for k in range(n)]
    top, bottom = F.lit(0.0), F.lit(0.0)
    for v, weight in values:
        top += F.coalesce(v * weight, F.lit(0.0))
        bottom += F.when(v.isNotNull(), float(weight)).otherwise(0.0)
    return top / bottom


_add("ind_sma", lambda w: F.avg("close").over(w.rows(10)), lookback=9)
_add("ind_wma", lambda w: wma(w, "close", 10), lookback=9)
_HMA = 16
_add("hma_full_", lambda w: wma(w, "close", _HMA), lookback=_HMA - 1)
_add("hma_half_", lambda w: wma(w, "close", _HMA // 2), lookback=_HMA // 2 - 1)
_add("hma_diff_", lambda w: 2 * _c("hma_half_") - _c("hma_full_"), ("hma_half_", "hma_full_"))
_add("ind_hma", lambda w: wma(w, "hma_diff_", isqrt(_HMA)), ("hma_diff_",), isqrt(_HMA) - 1)
# regression over the last n closes, x = 1..n
_add("row_", lambda w: F.row_number().over(w.base), inputs=())
for _name, _fn in (
    ("slope", lambda w: w.full(20, F.regr_slope("close", "row_"), "close")),
    ("last", lambda w: w.full(20, F.regr_slope("close", "row_"), "close") * _c("row_") + w.full(20, F.regr_intercept("close", "row_"), "close")),
    ("r2", lambda w: w.full(20, F.regr_r2("close", "row_"), "close")),
):
    _add(f"linreg_{_name}_", _fn, ("row_",), 19)
_add("ind_linreg", lambda w: _c("linreg_last_"), ("linreg_last_",))
_add("linreg_intercept", lambda w: _c("linreg_last_") - 20 * _c("linreg_slope_"), ("linreg_last_", "linreg_slope_"))
_add("linreg_degree", lambda w: F.degrees(F.atan("linreg_slope_")), ("linreg_slope_",))
_add("linreg_cfo", lambda w: 100 * (_c("linreg_last_") - _c("close")) / F.nullif(_c("close"), F.lit(0.0)), ("linreg_last_",))
_add("linreg_r2", lambda w: _c("linreg_r2_"), ("linreg_r2_",))
# momentum
_N = 14


def _since(w: Line, value: Column, n: int) -> Column:
    """Rows since the best of the last n, the earliest of ties."""
    return _c("row_") - F.min_by("row_", F.struct(value, "row_")).over(w.rows(n))


_add("aroon_up", lambda w: _ready(w, _N + 1, 100.0 * (_N - _since(w, -_c("high"), _N + 1)) / _N), ("row_",), _N, ("high",))
_add("aroon_down", lambda w: _ready(w, _N + 1, 100.0 * (_N - _since(w, _c("low"), _N)) / _N), ("row_",), _N, ("low",))
_add("ind_aroon", lambda w: _c("aroon_up") - _c("aroon_down"), ("aroon_up", "aroon_down"))
_add("tp_", lambda w: (_c("high") + _c("low") + _c("close")) / 3, inputs=("high", "low", "close"))
_add("tp_mean_", lambda w: F.avg("tp_").over(w.rows(20)), ("tp_",), 19)
_add("tp_sd_", lambda w: F.stddev_pop("tp_").over(w.rows(20)), ("tp_",), 19)
_add("bollinger_upper", lambda w: _c("tp_mean_") + 2 * _c("tp_sd_"), ("tp_mean_", "tp_sd_"))
_add("bollinger_lower", lambda w: _c("tp_mean_") - 2 * _c("tp_sd_"), ("tp_mean_", "tp_sd_"))
_add("ind_bollinger", lambda w: _c("tp_mean_"), ("tp_mean_",))
_add("ind_bias", lambda w: _c("close") / F.avg("close").over(w.rows(10)) - 1, lookback=9)
_add("tp_list_", lambda w: F.collect_list("tp_").over(w.rows(20)), ("tp_",), 19)
_add("mad_", lambda w: F.aggregate(F.transform("tp_list_", lambda x: F.abs(x - _c("tp_mean_"))), F.lit(0.0), lambda a, b: a + b) / F.size("tp_list_"), ("tp_list_", "tp_mean_"))
_add("ind_cci", lambda w: _ready(w, 20, (_c("tp_") - _c("tp_mean_")) / F.nullif(0.015 * _c("mad_"), F.lit(0.0))), ("tp_", "tp_mean_", "mad_"), 19)


def _mid(w: Line, n: int) -> Column:
    return (F.max("high").over(w.rows(n)) + F.min("low").over(w.rows(n))) / 2


_add("tenkan", lambda w: _mid(w, 9), lookback=8, inputs=("high", "low"))
_add("kijun", lambda w: _mid(w, 26), lookback=25, inputs=("high", "low"))
_add("mid52_", lambda w: _ready(w, 52, _mid(w, 52)), lookback=51, inputs=("high", "low"))
_add("mid_", lambda w: F.when(_c("mid52_").isNotNull(), (_c("tenkan") + _c("kijun")) / 2), ("mid52_", "tenkan", "kijun"))
_add("senkou_a", lambda w: w.lag("mid_", 26), ("mid_",), 26)
_add("senkou_b", lambda w: w.lag("mid52_", 26), ("mid52_",), 26)
_add("chikou", lambda w: F.when(w.lag("mid52_", 26).isNotNull(), w.lag("close", 26)), ("mid52_",), 26)
_add("ind_ichimoku", lambda w: _c("senkou_a") - _c("senkou_b"), ("senkou_a", "senkou_b"))
_add("kvo_signed_", lambda w: _c("volume") * F.signum(_c("tp_") - F.coalesce(w.lag("tp_"), F.lit(0.0))), ("tp_",), 1, ("volume",))
_add("kvo_diff_", lambda w: _ready(w, 20, F.avg("kvo_signed_").over(w.rows(10)) - F.avg("kvo_signed_").over(w.rows(20))), ("kvo_signed_",), 19)
_add("ind_kvo", lambda w: F.avg("kvo_diff_").over(w.rows(5)), ("kvo_diff_",), 4)
_add("ind_obv", lambda w: F.sum(F.signum(_c("close") - _c("open")) * _c("volume")).over(w.rows(20)), lookback=19, inputs=("open", "close", "volume"))
_add("up_", lambda w: F.when(_c("close") > w.lag("close"), 1.0).otherwise(0.0), lookback=1)
_add("ind_psl", lambda w: 100 * F.avg("up_").over(w.rows(20)), ("up_",), 19)
_add("ind_roc", lambda w: _c("close") / F.first("close").over(w.rows(10)) - 1, lookback=9)
_add("roc_log", lambda w: F.log10(_c("close") / F.first("close").over(w.rows(10))), lookback=9)
_add("k_low_", lambda w: F.min("low").over(w.rows(_N)), lookback=_N - 1, inputs=("low",))
_add("k_range_", lambda w: F.max("high").over(w.rows(_N)) - F.min("low").over(w.rows(_N)), lookback=_N - 1, inputs=("high", "low"))
_add("ind_stochastics", lambda w: _ready(w, _N, 100 * (_c("close") - _c("k_low_")) / F.nullif(_c("k_range_"), F.lit(0.0))), ("k_low_", "k_range_"), _N - 1)
_add("k_part_", lambda w: _c("close") - _c("k_low_"), ("k_low_",))
_add("stochastics_d", lambda w: _ready(w, _N, 100 * F.sum("k_part_").over(w.rows(3)) / F.nullif(F.sum("k_range_").over(w.rows(3)), F.lit(0.0))), ("k_part_", "k_range_"), _N)
_add("move_", lambda w: F.abs(F.coalesce(_c("close") - w.lag("close"), F.lit(0.0))), lookback=1)
_add("ind_vhf", lambda w: F.when(F.count(F.lit(1)).over(w.rows(_N + 1)) > _N, (F.max("close").over(w.rows(_N)) - F.min("close").over(w.rows(_N))) / _N / F.nullif(F.avg("move_").over(w.rows(_N)), F.lit(0.0))), ("move_",), _N)
# volatility
_add("spread_", lambda w: F.greatest("high", F.coalesce(w.lag("close"), "close")) - F.least("low", F.coalesce(w.lag("close"), "close")), lookback=1, inputs=("high", "low", "close"))
_add("ind_atr", lambda w: F.avg("spread_").over(w.rows(_N)), ("spread_",), _N - 1)
_add("donchian_upper", lambda w: F.max("high").over(w.rows(20)), lookback=19, inputs=("high",))
_add("donchian_lower", lambda w: F.min("low").over(w.rows(20)), lookback=19, inputs=("low",))
_add("ind_donchian", lambda w: (_c("donchian_upper") + _c("donchian_lower")) / 2, ("donchian_upper", "donchian_lower"))
_add("atr20_", lambda w: F.avg("spread_").over(w.rows(20)), ("spread_",), 19)
_add("ind_keltner", lambda w: _c("tp_mean_") + 2 * _c("atr20_"), ("tp_mean_", "atr20_"))
_add("keltner_lower", lambda w: _c("tp_mean_") - 2 * _c("atr20_"), ("tp_mean_", "atr20_"))
_add("ind_keltner_position", lambda w: F.when(_c("atr20_") > 0, (_c("close") - _c("tp_mean_")) / (2 * _c("atr20_"))).otherwise(0.0), ("tp_mean_", "atr20_"))
_add("rvi_sd_", lambda w: _ready(w, _N, F.stddev_samp("close").over(w.rows(_N))), lookback=_N - 1)
_add("rvi_up_", lambda w: F.when(_c("rvi_sd_").isNotNull(), F.when(_c("close") > w.lag("close"), _c("rvi_sd_")).otherwise(0.0)), ("rvi_sd_",), 1)
_add("rvi_down_", lambda w: F.when(_c("rvi_sd_").isNotNull(), F.when(_c("close") < w.lag("close"), _c("rvi_sd_")).otherwise(0.0)), ("rvi_sd_",), 1)
_add("ind_rvi", lambda w: 10 * F.avg("rvi_up_").over(w.rows(_N)) / F.nullif(F.avg("rvi_up_").over(w.rows(_N)) + F.avg("rvi_down_").over(w.rows(_N)), F.lit(0.0)), ("rvi_up_", "rvi_down_"), _N - 1)
_add("ind_volatility_ratio", lambda w: F.avg("spread_").over(w.rows(20)) / F.nullif(F.avg("spread_").over(w.rows(5)), F.lit(0.0)), ("spread_",), 19)
# quotes
_add("ind_spread_analyzer", lambda w: F.avg(_c("ask_price") - _c("bid_price")).over(w.rows(20)), lookback=19, inputs=("bid_price", "ask_price"), group="quotes")
_add("ind_book_imbalance", lambda w: F.least("bid_size", "ask_size") / F.nullif(F.greatest("bid_size", "ask_size"), F.lit(0.0)), inputs=("bid_size", "ask_size"), group="quotes")
# candles
_add("len_", lambda w: _c("high") - _c("low"), inputs=("high", "low"))
for _name, _top in (("body", lambda: F.abs(_c("open") - _c("close"))), ("upper", lambda: _c("high") - F.greatest("open", "close")), ("lower", lambda: F.least("open", "close") - _c("low"))):
    _add(f"{_name}_pct_", lambda w, t=_top: F.when(_c("len_") == 0, 0.0).otherwise(t() / _c("len_")), ("len_",), inputs=("open", "close"))
for _name in ("len", "body_pct", "upper_pct", "lower_pct"):
    _add(f"{_name}_m_", lambda w, x=f"{_name}_": F.avg(x).over(w.rows(10)), (f"{_name}_",), 9)
    _add(f"{_name}_s_", lambda w, x=f"{_name}_": F.stddev_pop(x).over(w.rows(10)), (f"{_name}_",), 9)


def _ladder(name: str, steps: tuple[float, ...]) -> Column:
    """0 for nothing, else the first step whose mean + step deviations is not exceeded."""
    x, m, s = _c(f"{name}_"), _c(f"{name}_m_"), _c(f"{name}_s_")
    out = F.when(x == 0, 0)
    for k, step in enumerate(steps, 1):
        out = out.when(x <= m + s * step + 1e-9, k)  # equality holds whatever the last bits are
    return out.otherwise(len(steps) + 1)


#: How far above the mean (in deviations) each class of size, body and wick reaches.
SIZES, BODIES, WICKS = (-1.0, 0.5, 1.0, 2.0, 3.0), (-0.5, 0.5, 1.0), (-0.5, 1.0)
_both = lambda n: (f"{n}_", f"{n}_m_", f"{n}_s_")
_add("candle_size", lambda w: _ladder("len", SIZES), _both("len"))
_add("candle_body", lambda w: _ladder("body_pct", BODIES), _both("body_pct"))
_add("candle_upper", lambda w: _ladder("upper_pct", WICKS), _both("upper_pct"))
_add("candle_lower", lambda w: _ladder("lower_pct", WICKS), _both("lower_pct"))
_add("ind_fuzzy_candles", lambda w: F.signum(_c("close") - _c("open")), inputs=("open", "close"))


# Recursive indicators


def vwap_day(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the start of the UTC day; the first price until there
    is volume."""
    tp = (_c("high") + _c("low") + _c("close")) / 3
    line = Window.partitionBy(KEY, "day_").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("day_", idiv(_c("event_time_ns"), DAY)).withColumn("tp_", tp)
    total = F.sum(_c("tp_") * _c("volume")).over(line) / F.nullif(F.sum("volume").over(line), F.lit(0.0))
    return rows.withColumn("ind_vwap_day", F.coalesce(total, F.first("tp_").over(line))).drop("day_", "tp_")


def emas(bars: DataFrame) -> DataFrame:
    """ind_ema (10), ind_rma (14), ewma (span 20) and is_ready flags, in one scan."""
    out = scan.ema(bars, {"ind_ema": ("close", 2 / 11), "ind_rma": ("close", 1 / 14), "ewma": ("close", 2 / 21)})
    return out


def dema(bars: DataFrame, n: int = 10) -> DataFrame:
    out = scan.ema(scan.ema(bars, {"e1_": ("close", 2 / (n + 1))}), {"e2_": ("e1_", 2 / (n + 1))})
    return out.withColumn("ind_dema", 2 * _c("e1_") - _c("e2_")).drop("e1_", "e2_")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, its signal line and their difference."""
    out = scan.ema(bars, {"f_": ("close", 2 / (fast + 1)), "s_": ("close", 2 / (slow + 1))}).withColumn("macd", _c("f_") - _c("s_")).drop("f_", "s_")
    return scan.ema(out, {"macd_signal": ("macd", 2 / (signal + 1))}).withColumn("macd_hist", _c("macd") - _c("macd_signal"))


def _changes(bars: DataFrame) -> DataFrame:
    """Gain and loss against the bar before (0 on an instrument's first), and the bar's number."""
    rows = scan.halo(bars, 1).withColumn("d_", F.coalesce(_c("close") - F.lag("close").over(Window.partitionBy(KEY, "block_").orderBy(*ORDER)), F.lit(0.0)))
    rows = rows.where("home_").withColumn("n_", _c("ord_") + 1).drop("home_", "block_", "ord_")
    return rows.withColumn("gain_", F.greatest("d_", F.lit(0.0))).withColumn("loss_", F.greatest(-_c("d_"), F.lit(0.0))).drop("d_")


def cmo(bars: DataFrame, n: int = 14) -> DataFrame:
    rows = scan.ema(_changes(bars), {"g_": ("gain_", 1 / n), "l_": ("loss_", 1 / n)})
    value = F.when(_c("g_") + _c("l_") == 0, 0.0).otherwise(100 * (_c("g_") - _c("l_")) / (_c("g_") + _c("l_")))
    return rows.withColumn("ind_cmo", F.when(_c("n_") >= n, value)).drop("g_", "l_", "gain_", "loss_")


def vidya(bars: DataFrame, n: int = 14) -> DataFrame:
    """Exponential mean whose weight follows |CMO|; starts from 0 on the bar after CMO is ready."""
    rows = cmo(bars, n)
    share = F.abs("ind_cmo") / 100 * (2 / (n + 1))
    rows = rows.withColumn("a_", F.when(_c("n_") > n, 1 - share)).withColumn("b_", F.when(_c("n_") > n, share * _c("close")))
    return scan.affine_scan(rows, {"ind_vidya": ("a_", "b_")}).drop("a_", "b_", "n_", "ind_cmo")


def efficiency(bars: DataFrame) -> DataFrame:
    """Net move from the first close over the path since then; 0 on the first bar."""
    rows = _changes(bars)
    rows = scan.prefix(rows, {"path_": _c("gain_") + _c("loss_")}).drop("ord_")
    first = bars.groupBy(KEY).agg(F.min_by("close", F.struct(*ORDER)).alias("first_"))
    rows = rows.join(first, KEY)
    return rows.withColumn("ind_efficiency_ratio", F.when(_c("path_") == 0, 0.0).otherwise(F.abs(_c("close") - _c("first_")) / _c("path_"))).drop("gain_", "loss_", "first_", "path_")


def ama(bars: DataFrame, fast: int = 2, slow: int = 30) -> DataFrame:
    """Adaptive mean: the weight is the square of a rate between fast and slow by efficiency."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    rows = efficiency(bars).withColumn("k_", F.pow(_c("ind_efficiency_ratio") * (a - b) + b, F.lit(2.0)))
    rows = rows.withColumn("a_", F.when(_c("n_") > 1, 1 - _c("k_"))).withColumn("b_", F.when(_c("n_") > 1, _c("k_") * _c("close")).otherwise(_c("close")))
    return scan.affine_scan(rows, {"ind_ama": ("a_", "b_")}).drop("a_", "b_", "k_", "n_", "ind_efficiency_ratio")


def dm(bars: DataFrame, n: int = 14) -> DataFrame:
    """Smoothed upward and downward movement."""
    rows = scan.halo(bars, 1)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    up, down = _c("high") - F.lag("high").over(line), F.lag("low").over(line) - _c("low")
    rows = scan.home(rows.withColumn("up_", F.coalesce(up, F.lit(0.0))).withColumn("dn_", F.coalesce(down, F.lit(0.0))))
    rows = rows.withColumn("p_", F.when((_c("up_") > _c("dn_")) & (_c("up_") > 0), _c("up_")).otherwise(0.0))
    rows = rows.withColumn("m_", F.when((_c("dn_") > _c("up_")) & (_c("dn_") > 0), _c("dn_")).otherwise(0.0))
    return scan.ema(rows, {"dm_pos": ("p_", 2 / (n + 1)), "dm_neg": ("m_", 2 / (n + 1))}).drop("up_", "dn_", "p_", "m_")


def pressure(bars: DataFrame, n: int = 14) -> DataFrame:
    """Buying less selling pressure against range and volume means, and its running sum."""
    rows = scan.halo(bars, 1)
    before = F.coalesce(F.lag("close").over(Window.partitionBy(KEY, "block_").orderBy(*ORDER)), _c("close"))
    rows = scan.home(rows.withColumn("tr_", F.greatest(before, "high") - F.least("low", before)))
    rows = scan.ema(rows, {"atr_": ("tr_", 2 / (n + 1)), "av_": ("volume", 2 / (n + 1))})
    width = F.when(_c("atr_") > 0, _c("atr_")).otherwise(F.abs(_c("high") - _c("low")))
    value = F.when((_c("av_") == 0) | (width == 0), 0.0).otherwise(((_c("close") - _c("low")) - (_c("high") - _c("close"))) / width * _c("volume") / _c("av_"))
    rows = rows.withColumn("ind_pressure", value)
    return scan.prefix(rows, {"pressure_cumulative": _c("ind_pressure")}).drop("tr_", "atr_", "av_", "ord_")


def amat(bars: DataFrame, fast: int = 8, slow: int = 21, signal: int = 5) -> DataFrame:
    """Trend flags of the fast mean against its value `signal` bars before; once true they stay."""
    rows = scan.halo(scan.ema(bars, {"f_": ("close", 2 / (fast + 1))}), signal)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    # the buffer begins with the bar on which the slow mean is ready
    back = F.coalesce(F.when(_c("ord_") - signal >= slow - 1, F.lag("f_", signal).over(line)))
    start = rows.where(F.col("home_") & (F.col("ord_") == slow - 1)).select(KEY, F.col("f_").alias("s_"))
    rows = rows.withColumn("b_", back).where("home_").join(start, KEY, "left")
    diff = F.when(_c("ord_") >= slow - 1, _c("f_") - F.coalesce("b_", "s_"))
    rows = rows.withColumn("d_", diff).drop("home_", "block_", "ord_", "b_", "s_", "f_")
    rows = rows.withColumn("up_", F.coalesce((_c("d_") > 0).cast("int"), F.lit(0))).withColumn("dn_", F.coalesce((_c("d_") < 0).cast("int"), F.lit(0)))
    rows = scan.running_max(scan.running_max(rows, "up_", "long_"), "dn_", "short_")
    return rows.withColumn("amat_long", _c("long_") > 0).withColumn("amat_short", _c("short_") > 0).drop("d_", "up_", "dn_", "long_", "short_")


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI: seeded with the mean of the first n changes, 100 without losses."""
    rows = _changes(bars)  # n_ = 1 is the first bar, which has no change
    seeds = rows.where((_c("n_") > 1) & (_c("n_") <= n + 1)).groupBy(KEY).agg(F.avg("gain_").alias("sg_"), F.avg("loss_").alias("sl_"))
    rows = rows.join(seeds, KEY, "left")
    for out, seed in (("gain_", "sg_"), ("loss_", "sl_")):
        rows = rows.withColumn(f"{out}b", F.when(_c("n_") == n + 1, _c(seed)).when(_c("n_") > n + 1, _c(out) / n))
    rows = rows.withColumn("a_", F.when(_c("n_") > n + 1, 1 - 1 / n))
    rows = scan.affine_scan(rows, {"g_": ("a_", "gain_b"), "l_": ("a_", "loss_b")})
    value = F.when(_c("l_") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + _c("g_") / _c("l_")))
    return rows.withColumn("feat_rsi_14", F.when(_c("n_") > n, value)).drop("gain_", "loss_", "sg_", "sl_", "gain_b", "loss_b", "a_", "g_", "l_", "n_")


def vwm_setup(bars: DataFrame, back: int = 5, n: int = 20, atr: int = 5) -> DataFrame:
    """Momentum, the exponential mean of volume times momentum, ATR, and crossings of zero."""
    rows = REGISTRY.layered(scan.halo(bars, max(back, atr)), ["true_range"], "block_")
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    rows = rows.withColumn("momentum", _c("close") - F.lag("close", back).over(line))
    few = line.rowsBetween(1 - atr, 0)
    rows = rows.withColumn("atr", F.when(F.count("true_range").over(few) >= atr, F.avg("true_range").over(few)))
    rows = scan.home(rows).withColumn("x_", _c("volume") * _c("momentum"))
    rows = scan.halo(scan.ema(rows, {"vwm": ("x_", 2 / (n + 1))}), 1)
    rows = rows.withColumns({"prev_vwm": F.lag("vwm").over(line), "prev_atr": F.lag("atr").over(line)})
    over = F.coalesce((_c("prev_vwm") <= 0) & (_c("vwm") > 0), F.lit(False))
    under = F.coalesce((_c("prev_vwm") >= 0) & (_c("vwm") < 0), F.lit(False))
    return scan.home(rows.withColumns({"bull_setup": over, "bear_setup": under})).drop("x_", "true_range")


# State machines


def rsi_exact(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI in 0..1 whose reference price moves on only while losses have a mean.

    Gains and losses are measured from the reference price; their exponential means start with
    the first bar, which has neither. The reference depends on the state, so an instrument is one
    task."""
    keep = 1 - 2 / (n + 1)

    def step(rows: Iterator[tuple], key: str) -> Iterator[tuple]:
        reference, gains, losses = None, 0.0, 0.0
        for t, s, price in rows:
            change = 0.0 if reference is None else price - reference
            gains = keep * gains + (1 - keep) * max(change, 0.0)
            losses = keep * losses + (1 - keep) * max(-change, 0.0)
            if reference is None or losses > 0:
                reference = price
            yield key, t, s, gains / (gains + losses) if losses > 0 else 1.0

    return scan.fold(bars, step, ["event_time_ns", "seq", "close"], f"{KEY} string, event_time_ns long, seq long, ind_rsi double")


def swings(bars: DataFrame, n: int = 10) -> DataFrame:
    """Direction, length and duration of the present swing.

    A bar turns the swing up where its high is its window's highest and its low isn't the lowest,
    and down the other way round. The swing's top is the highest high of up bars and its bottom
    the lowest low of down bars; the first down bar (or a bar that is both, alone in its window)
    gives a top where there is none. Length and duration are null until both are known; the
    duration counts bars since the last bar of the other direction. Windows give the extremes.
    """
    rows = scan.halo(bars, n - 1)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER).rowsBetween(1 - n, 0)
    rows = rows.withColumns({"top_": F.max("high").over(line), "bottom_": F.min("low").over(line)})
    rows = scan.home(rows.withColumns({"up_": _c("high") >= _c("top_"), "down_": _c("low") <= _c("bottom_")}))

    def step(history: Iterator[tuple], key: str) -> Iterator[tuple]:
        direction, top, bottom = 0, None, None
        last = {1: -1, -1: -1}  # places of the last bars of each direction
        for place, (t, s, high, low, up, down, window_top) in enumerate(history):
            before = direction
            if up and not down:
                direction, top = 1, high if top is None else max(top, high)
            elif down and not up:
                direction, bottom = -1, low if bottom is None else min(bottom, low)
            if down and top is None:
                top = window_top
            if up != down:
                last[direction] = place
            known = top is not None and bottom is not None
            turned = direction != 0 and before == -direction
            yield key, t, s, direction, turned, abs(top - bottom) if known else None, (place - last[-direction] if direction else 0) if known else None

    kind = f"{KEY} string, event_time_ns long, seq long, direction int, changed boolean, length double, duration int"
    return scan.fold(rows, step, ["event_time_ns", "seq", "high", "low", "up_", "down_", "top_"], kind)
