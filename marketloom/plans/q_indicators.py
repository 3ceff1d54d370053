"""Queries of the technical indicators with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.features import REGISTRY
from marketloom.operators import indicators as I
from marketloom.plans import views as V
from marketloom.plans.q_features import EXPR, KEYS, LINE, NUDGE, R, _feature_query, full, lag, rounded


def wma(x: str, n: int) -> str:
    parts = [(x if k == 0 else lag(x, k), n - k) for k in range(n)]
    return f"({' + '.join(f'coalesce({v} * {w}, 0)' for v, w in parts)}) / ({' + '.join(f'CASE WHEN {v} IS NOT NULL THEN {w}.0::DOUBLE ELSE 0 END' for v, w in parts)})"


def ready(n: int, x: str) -> str:
    return f"CASE WHEN {R('count(*)', n)} >= {n} THEN {x} END"


def since(order: str, n: int) -> str:
    return f"(row_ - {R(f'arg_min(row_, struct_pack(a := {order}, b := row_))', n)})"


def ladder(name: str, steps) -> str:
    whens = " ".join(f"WHEN {name}_ <= {name}_m_ + {name}_s_ * {s}::DOUBLE + 1e-9 THEN {k}" for k, s in enumerate(steps, 1))
    return f"CASE WHEN {name}_ = 0 THEN 0 {whens} ELSE {len(steps) + 1} END"


mid = lambda n: f"({R('max(high)', n)} + {R('min(low)', n)}) / 2"
EXPR.update({
    "ind_sma": R("avg(close)", 10), "ind_wma": wma("close", 10), "hma_full_": wma("close", 16), "hma_half_": wma("close", 8),
    "hma_diff_": "2 * hma_half_ - hma_full_", "ind_hma": wma("hma_diff_", 4), "row_": f"row_number() OVER ({LINE})",
    "linreg_slope_": ready(20, R("regr_slope(close, row_)", 20)), "linreg_r2_": ready(20, R("regr_r2(close, row_)", 20)),
    "linreg_last_": ready(20, f"{R('regr_slope(close, row_)', 20)} * row_ + {R('regr_intercept(close, row_)', 20)}"),
    "ind_linreg": "linreg_last_", "linreg_intercept": "linreg_last_ - 20 * linreg_slope_", "linreg_degree": "degrees(atan(linreg_slope_))",
    "linreg_cfo": "100 * (linreg_last_ - close) / nullif(close, 0)", "linreg_r2": "linreg_r2_",
    "aroon_up": ready(15, f"100.0::DOUBLE * (14 - {since('-high', 15)}) / 14"), "aroon_down": ready(15, f"100.0::DOUBLE * (14 - {since('low', 14)}) / 14"),
    "ind_aroon": "aroon_up - aroon_down", "tp_": "(high + low + close) / 3", "tp_mean_": R("avg(tp_)", 20), "tp_sd_": R("stddev_pop(tp_)", 20),
    "bollinger_upper": "tp_mean_ + 2 * tp_sd_", "bollinger_lower": "tp_mean_ - 2 * tp_sd_", "ind_bollinger": "tp_mean_", "ind_bias": f"close / {R('avg(close)', 10)} - 1",
    "tp_list_": R("list(tp_)", 20), "mad_": "list_avg(list_transform(tp_list_, lambda x: abs(x - tp_mean_)))",
    "ind_cci": ready(20, "(tp_ - tp_mean_) / nullif(0.015::DOUBLE * mad_, 0)"), "tenkan": mid(9), "kijun": mid(26), "mid52_": ready(52, mid(52)),
    "mid_": "CASE WHEN mid52_ IS NOT NULL THEN (tenkan + kijun) / 2 END", "senkou_a": lag("mid_", 26), "senkou_b": lag("mid52_", 26),
    "chikou": f"CASE WHEN {lag('mid52_', 26)} IS NOT NULL THEN {lag('close', 26)} END", "ind_ichimoku": "senkou_a - senkou_b",
    "kvo_signed_": f"volume * sign(tp_ - coalesce({lag('tp_')}, 0))", "kvo_diff_": ready(20, f"{R('avg(kvo_signed_)', 10)} - {R('avg(kvo_signed_)', 20)}"),
    "ind_kvo": R("avg(kvo_diff_)", 5), "ind_obv": R("sum(sign(close - open) * volume)", 20), "up_": f"CASE WHEN close > {lag('close')} THEN 1.0::DOUBLE ELSE 0 END",
    "ind_psl": f"100 * {R('avg(up_)', 20)}", "ind_roc": f"close / {R('first_value(close)', 10)} - 1", "roc_log": f"log10(close / {R('first_value(close)', 10)})",
    "k_low_": R("min(low)", 14), "k_range_": f"{R('max(high)', 14)} - {R('min(low)', 14)}", "ind_stochastics": ready(14, "100 * (close - k_low_) / nullif(k_range_, 0)"),
    "k_part_": "close - k_low_", "stochastics_d": ready(14, f"100 * {R('sum(k_part_)', 3)} / nullif({R('sum(k_range_)', 3)}, 0)"),
    "move_": f"abs(coalesce(close - {lag('close')}, 0))", "ind_vhf": ready(15, f"({R('max(close)', 14)} - {R('min(close)', 14)}) / 14 / nullif({R('avg(move_)', 14)}, 0)"),
    "spread_": f"greatest(high, coalesce({lag('close')}, close)) - least(low, coalesce({lag('close')}, close))", "ind_atr": R("avg(spread_)", 14),
    "donchian_upper": R("max(high)", 20), "donchian_lower": R("min(low)", 20), "ind_donchian": "(donchian_upper + donchian_lower) / 2", "atr20_": R("avg(spread_)", 20),
    "ind_keltner": "tp_mean_ + 2 * atr20_", "keltner_lower": "tp_mean_ - 2 * atr20_", "ind_keltner_position": "CASE WHEN atr20_ > 0 THEN (close - tp_mean_) / (2 * atr20_) ELSE 0 END",
    "rvi_sd_": full("stddev_samp", "close", 14), "rvi_up_": f"CASE WHEN rvi_sd_ IS NOT NULL THEN CASE WHEN close > {lag('close')} THEN rvi_sd_ ELSE 0 END END",
    "rvi_down_": f"CASE WHEN rvi_sd_ IS NOT NULL THEN CASE WHEN close < {lag('close')} THEN rvi_sd_ ELSE 0 END END",
    "ind_rvi": f"10 * {R('avg(rvi_up_)', 14)} / nullif({R('avg(rvi_up_)', 14)} + {R('avg(rvi_down_)', 14)}, 0)",
    "ind_volatility_ratio": f"{R('avg(spread_)', 20)} / nullif({R('avg(spread_)', 5)}, 0)", "ind_spread_analyzer": R("avg(ask_price - bid_price)", 20),
    "ind_book_imbalance": "least(bid_size, ask_size) / nullif(greatest(bid_size, ask_size), 0)", "len_": "high - low",
    "body_pct_": "CASE WHEN len_ = 0 THEN 0 ELSE abs(open - close) / len_ END", "upper_pct_": "CASE WHEN len_ = 0 THEN 0 ELSE (high - greatest(open, close)) / len_ END",
    "lower_pct_": "CASE WHEN len_ = 0 THEN 0 ELSE (least(open, close) - low) / len_ END",
    **{f"{n}_m_": R(f"avg({n}_)", 10) for n in ("len", "body_pct", "upper_pct", "lower_pct")}, **{f"{n}_s_": R(f"stddev_pop({n}_)", 10) for n in ("len", "body_pct", "upper_pct", "lower_pct")},
    "candle_size": ladder("len", I.SIZES), "candle_body": ladder("body_pct", I.BODIES), "candle_upper": ladder("upper_pct", I.WICKS), "candle_lower": ladder("lower_pct", I.WICKS),
    "ind_fuzzy_candles": "sign(close - open)::DOUBLE",
})

#: Further outputs of an indicator besides the one that bears its name.
ALSO = {
    "ind_linreg": ["linreg_slope_", "linreg_intercept", "linreg_degree", "linreg_cfo", "linreg_r2"], "ind_aroon": ["aroon_up", "aroon_down"],
    "ind_bollinger": ["bollinger_upper", "bollinger_lower"], "ind_ichimoku": ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"], "ind_roc": ["roc_log"],
    "ind_stochastics": ["stochastics_d"], "ind_donchian": ["donchian_upper", "donchian_lower"], "ind_keltner": ["keltner_lower"],
    "ind_fuzzy_candles": ["candle_size", "candle_body", "candle_upper", "candle_lower"],
}
QUERIES, ORACLES = {}, {}
for _f in list(REGISTRY.known.values()):
    if _f.name.startswith("ind_"):
        _view = "bars" if _f.group == "indicators" else _f.group
        QUERIES[_f.name], ORACLES[_f.name] = _feature_query([_f.name, *ALSO.get(_f.name, [])], _view)


def recursive(outs: dict[str, str], state: dict[str, tuple[str, str]], source: str = "v_bars", more: str = "") -> str:
    """Oracle of a recursion over each instrument's rows: state name -> (first, next), where n is
    the row and r the state before it; outs are computed from the state and the row."""
    names = list(state)
    return f"""WITH RECURSIVE {V.sql('v_bars')}, {more} n AS (SELECT *, row_number() OVER ({LINE}) AS k FROM {source}),
    r AS (SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, {', '.join(f'({state[s][0]})::DOUBLE AS {s}' for s in names)} FROM n WHERE k = 1
      UNION ALL SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, {', '.join(f'({state[s][1]})::DOUBLE' for s in names)}
      FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1)
    SELECT instrument_id, event_time_ns, seq, {', '.join(f'round({e} + {NUDGE}, 6) AS {o}' for o, e in outs.items())} FROM r"""


def ema_state(name: str, x: str, alpha: str) -> dict[str, tuple[str, str]]:
    return {name: (f"n.{x}", f"r.{name} + {alpha} * (n.{x} - r.{name})")}


def _query(name: str, fn, outs: list[str], oracle: str):
    QUERIES[name] = lambda spark, sf_dir: rounded(fn(V.bars(spark, sf_dir)), outs)
    ORACLES[name] = oracle


_query("ind_ema", I.emas, ["ind_ema"], recursive({"ind_ema": "e"}, ema_state("e", "close", "(2.0::DOUBLE / 11)")))
_query("ind_rma", I.emas, ["ind_rma"], recursive({"ind_rma": "e"}, ema_state("e", "close", "(1.0::DOUBLE / 14)")))
_query("ewma", I.emas, ["ewma"], recursive({"ewma": "e"}, ema_state("e", "close", "(2.0::DOUBLE / 21)")))
_a = "(2.0::DOUBLE / 11)"
_e1 = f"(r.e + {_a} * (n.close - r.e))"
_query("ind_dema", I.dema, ["ind_dema"], recursive({"ind_dema": "2 * e - d"}, {"e": ("n.close", _e1), "d": ("n.close", f"r.d + {_a} * ({_e1} - r.d)")}))
_f, _s = "(r.f + (2.0::DOUBLE / 13) * (n.close - r.f))", "(r.s + (2.0::DOUBLE / 27) * (n.close - r.s))"
_macd = {"f": ("n.close", _f), "s": ("n.close", _s), "g": ("0.0", f"r.g + 0.2::DOUBLE * ({_f} - {_s} - r.g)")}
_query("feat_macd", I.macd, ["macd", "macd_signal", "macd_hist"], recursive({"macd": "f - s", "macd_signal": "g", "macd_hist": "f - s - g"}, _macd))
QUERIES["ind_macd"] = lambda spark, sf_dir: rounded(I.macd(V.bars(spark, sf_dir)).withColumnRenamed("macd", "ind_macd"), ["ind_macd"])
ORACLES["ind_macd"] = recursive({"ind_macd": "f - s"}, {k: _macd[k] for k in "fs"})
_d = "c AS (SELECT *, greatest(coalesce(d, 0), 0) AS gain, greatest(-coalesce(d, 0), 0) AS loss FROM (SELECT *, close - lag(close) OVER (" + LINE + ") AS d FROM v_bars)),"
_w = "(1.0::DOUBLE / 14)"
_g = {"g": ("n.gain", f"r.g + {_w} * (n.gain - r.g)"), "l": ("n.loss", f"r.l + {_w} * (n.loss - r.l)"), "m": ("1", "n.k"), "c": ("n.close", "n.close")}
_query("ind_cmo", I.cmo, ["ind_cmo"], recursive({"ind_cmo": "(CASE WHEN m >= 14 THEN CASE WHEN g + l = 0 THEN 0 ELSE 100 * (g - l) / (g + l) END END)"}, _g, "c", _d))
_gn, _ln = _g["g"][1], _g["l"][1]
_cmo = f"abs(CASE WHEN ({_gn}) + ({_ln}) = 0 THEN 0 ELSE (({_gn}) - ({_ln})) / (({_gn}) + ({_ln})) END)"
_sh = f"((2.0::DOUBLE / 15) * {_cmo})"
_query("ind_vidya", I.vidya, ["ind_vidya"], recursive({"ind_vidya": "(CASE WHEN m > 14 THEN v END)"}, _g | {"v": ("0.0", f"CASE WHEN n.k > 14 THEN {_sh} * n.close + (1 - {_sh}) * r.v ELSE 0 END")}, "c", _d))
_path = f"p AS (SELECT *, CASE WHEN path = 0 THEN 0 ELSE abs(close - first_close) / path END AS er FROM (SELECT *, sum(gain + loss) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS path, first_value(close) OVER ({LINE}) AS first_close FROM c))"
QUERIES["ind_efficiency_ratio"] = lambda spark, sf_dir: rounded(I.efficiency(V.bars(spark, sf_dir)), ["ind_efficiency_ratio"])
ORACLES["ind_efficiency_ratio"] = f"WITH {V.sql('v_bars')}, {_d} {_path} SELECT instrument_id, event_time_ns, seq, round(er + {NUDGE}, 6) AS ind_efficiency_ratio FROM p"
_k = "pow(n.er * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2)"
_query("ind_ama", I.ama, ["ind_ama"], recursive({"ind_ama": "y"}, {"y": ("n.close", f"r.y + {_k} * (n.close - r.y)")}, "p", f"{_d} {_path},"))
_m = f"q AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM (SELECT *, coalesce(high - lag(high) OVER ({LINE}), 0) AS up, coalesce(lag(low) OVER ({LINE}) - low, 0) AS dn FROM v_bars)),"
_query("ind_dm", I.dm, ["dm_pos", "dm_neg"], recursive({"dm_pos": "a", "dm_neg": "b"}, ema_state("a", "p", "(2.0::DOUBLE / 15)") | ema_state("b", "m", "(2.0::DOUBLE / 15)"), "q", _m))
_t = f"q AS (SELECT *, greatest(pc, high) - least(low, pc) AS tr FROM (SELECT *, coalesce(lag(close) OVER ({LINE}), close) AS pc FROM v_bars)),"
_at, _av = "(r.a + (2.0::DOUBLE / 15) * (n.tr - r.a))", "(r.v + (2.0::DOUBLE / 15) * (n.volume - r.v))"


def _pressure(a: str, v: str) -> str:
    w = f"(CASE WHEN {a} > 0 THEN {a} ELSE abs(n.high - n.low) END)"
    return f"CASE WHEN {v} = 0 OR {w} = 0 THEN 0 ELSE ((n.close - n.low) - (n.high - n.close)) / {w} * n.volume / {v} END"


_p0, _p1 = _pressure("n.tr", "n.volume"), _pressure(_at, _av)
_query("ind_pressure", I.pressure, ["ind_pressure", "pressure_cumulative"], recursive({"ind_pressure": "x", "pressure_cumulative": "y"}, {"a": ("n.tr", _at), "v": ("n.volume", _av), "x": (_p0, _p1), "y": (_p0, f"r.y + {_p1}")}, "q", _t))
QUERIES["ind_vwap_day"] = lambda spark, sf_dir: rounded(I.vwap_day(V.bars(spark, sf_dir)), ["ind_vwap_day"])
_D = "OVER (PARTITION BY instrument_id, event_time_ns // 86400000000000 ORDER BY event_time_ns, seq ROWS UNBOUNDED PRECEDING)"
ORACLES["ind_vwap_day"] = f"WITH {V.sql('v_bars')}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM v_bars) SELECT instrument_id, event_time_ns, seq, round(coalesce(sum(tp * volume) {_D} / nullif(sum(volume) {_D}, 0), first_value(tp) {_D}) + {NUDGE}, 6) AS ind_vwap_day FROM t"
QUERIES["ind_amat"] = lambda spark, sf_dir: I.amat(V.bars(spark, sf_dir)).select(*KEYS, "amat_long", "amat_short")
_fa = "(r.f + (2.0::DOUBLE / 9) * (n.close - r.f))"
ORACLES["ind_amat"] = f"""WITH RECURSIVE {V.sql('v_bars')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k FROM v_bars),
  r AS (SELECT k, instrument_id, event_time_ns, seq, close AS f FROM n WHERE k = 1 UNION ALL SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, {_fa} FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1),
  d AS (SELECT r.*, CASE WHEN r.k >= 21 THEN r.f - b.f END AS d FROM r LEFT JOIN r b ON b.instrument_id = r.instrument_id AND b.k = greatest(21, r.k - 5))
  SELECT instrument_id, event_time_ns, seq, coalesce(bool_or(d > 0) OVER w, false) AS amat_long, coalesce(bool_or(d < 0) OVER w, false) AS amat_short FROM d
  WINDOW w AS (PARTITION BY instrument_id ORDER BY k ROWS UNBOUNDED PRECEDING)"""
_query("feat_rsi_14", I.rsi_wilder, ["feat_rsi_14"], recursive(
    {"feat_rsi_14": "(CASE WHEN m > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END)"},
    {x: ("0.0", f"CASE WHEN n.k < 15 THEN r.{x} + n.{c} WHEN n.k = 15 THEN (r.{x} + n.{c}) / 14 ELSE (r.{x} * 13 + n.{c}) / 14 END") for x, c in (("g", "gain"), ("l", "loss"))} | {"m": ("1", "n.k")}, "c", _d))
_query("ind_rsi", I.rsi_exact, ["ind_rsi"], recursive(
    {"ind_rsi": "v"},
    {"p": ("n.close", "CASE WHEN {L} = 0 THEN r.p ELSE n.close END"), "u": ("0.0", "{U}"), "l": ("0.0", "{L}"), "v": ("1.0", "CASE WHEN {L} = 0 THEN 1.0 ELSE 1.0 - 1.0 / (1.0 + {U} / {L}) END")})
    .replace("{U}", "(r.u + (2.0::DOUBLE / 15) * (greatest(n.close - r.p, 0) - r.u))").replace("{L}", "(r.l + (2.0::DOUBLE / 15) * (greatest(r.p - n.close, 0) - r.l))"))


def _swings(spark, sf_dir):
    s = I.swings(V.bars(spark, sf_dir))
    return s.select(*KEYS, "direction", "changed", F.round(F.col("length") + NUDGE, 6).alias("length"), "duration")


QUERIES["ind_swings"] = _swings
_UP, _DN = "(n.high >= n.top AND n.low >= n.bottom)", "(n.high <= n.top AND n.low <= n.bottom)"


def _swing(prev: dict[str, str]) -> dict[str, str]:
    up, dn = f"({_UP} AND NOT {_DN})", f"({_DN} AND NOT {_UP})"
    p = prev
    return {
        "direction": f"CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE {p['direction']} END",
        "changed": f"CASE WHEN {up} THEN {p['direction']} = -1 WHEN {dn} THEN {p['direction']} = 1 ELSE false END",
        "hp": f"CASE WHEN {up} THEN greatest({p['hp']}, n.high) WHEN {dn} AND {p['hp']} = 0 THEN n.top WHEN {_UP} AND {_DN} AND {p['hp']} = 0 THEN n.high ELSE {p['hp']} END",
        "lp": f"CASE WHEN {dn} THEN CASE WHEN {p['lp']} = 0 THEN n.low ELSE least({p['lp']}, n.low) END ELSE {p['lp']} END",
        "sh": f"CASE WHEN {up} THEN 0 ELSE {p['sh']} + 1 END",
        "sl": f"CASE WHEN {dn} THEN 0 ELSE {p['sl']} + 1 END",
    }


_zero = _swing({"direction": "0", "hp": "0.0::DOUBLE", "lp": "0.0::DOUBLE", "sh": "0", "sl": "0"})
_next = _swing({k: f"r.{k}" for k in ("direction", "hp", "lp", "sh", "sl")})
ORACLES["ind_swings"] = f"""WITH RECURSIVE {V.sql('v_bars')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k, {R('max(high)', 10)} AS top, {R('min(low)', 10)} AS bottom FROM v_bars),
  r AS (SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, {', '.join(f'{v} AS {c}' for c, v in _zero.items())} FROM n WHERE k = 1
    UNION ALL SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, {', '.join(_next.values())} FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1)
  SELECT instrument_id, event_time_ns, seq, direction, changed, CASE WHEN hp <> 0 AND lp <> 0 THEN round(abs(hp - lp) + {NUDGE}, 6) END AS length,
    CASE WHEN hp <> 0 AND lp <> 0 THEN CASE direction WHEN 1 THEN sl WHEN -1 THEN sh ELSE 0 END END AS duration FROM r"""


def _setup(spark, sf_dir):
    return rounded(I.vwm_setup(V.bars(spark, sf_dir)), ["momentum", "vwm", "atr", "prev_vwm", "bull_setup", "bear_setup"])


QUERIES["feat_vwm_setup"] = _setup
_tr = EXPR["true_range"]
SETUP = f"""WITH RECURSIVE {V.sql('v_bars')}, a AS (SELECT *, {_tr} AS true_range, close - lag(close, 5) OVER ({LINE}) AS momentum, row_number() OVER ({LINE}) AS k FROM v_bars),
  n AS (SELECT *, {full('avg', 'true_range', 5)} AS atr, volume * momentum AS x FROM a),
  r AS (SELECT k, instrument_id, NULL::DOUBLE AS vwm FROM n WHERE k = 1 UNION ALL
    SELECT n.k, n.instrument_id, CASE WHEN n.x IS NULL THEN r.vwm WHEN r.vwm IS NULL THEN n.x ELSE r.vwm + (2.0::DOUBLE / 21) * (n.x - r.vwm) END FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1),
  s AS (SELECT n.*, r.vwm, lag(r.vwm) OVER (PARTITION BY n.instrument_id ORDER BY n.k) AS prev_vwm FROM n JOIN r ON n.instrument_id = r.instrument_id AND n.k = r.k)"""
ORACLES["feat_vwm_setup"] = f"""{SETUP}
  SELECT instrument_id, event_time_ns, seq, {', '.join(f'round({c} + {NUDGE}, 6) AS {c}' for c in ('momentum', 'vwm', 'atr', 'prev_vwm'))},
    coalesce(prev_vwm <= 0 AND vwm > 0, false) AS bull_setup, coalesce(prev_vwm >= 0 AND vwm < 0, false) AS bear_setup FROM s"""
