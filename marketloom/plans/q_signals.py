"""Queries of depth, options, swaps, funding and signals with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import book as K
from marketloom.operators import signals as G
from marketloom.plans import views as V
from marketloom.plans.q_features import EXPR, KEYS, LINE, NUDGE, P, R, full
from marketloom.plans.q_indicators import SETUP
from marketloom.schemas import HOUR

QUERIES, ORACLES = {}, {}
rnd = lambda c: F.round(F.col(c).cast("double") + NUDGE, 6).alias(c)
rs = lambda e, c: f"round({e} + {NUDGE}, 6) AS {c}"
DP = f"WITH {V.sql('v_depth')}"


def _limits(s, d):
    q = V.quotes(s, d)
    return q.select(F.col("seq").alias("snapshot_id"), F.explode(F.array(F.struct(F.lit("ASK").alias("side"), (F.col("ask_price") + 0.035).alias("limit")), F.struct(F.lit("BID").alias("side"), (F.col("bid_price") - 0.025).alias("limit")))).alias("x")).select("snapshot_id", "x.side", "x.limit")


_lim = "lim AS (SELECT seq AS snapshot_id, unnest([{'side': 'ASK', 'l': ask_price + 0.035::DOUBLE}, {'side': 'BID', 'l': bid_price - 0.025::DOUBLE}]) AS x FROM v_quotes), lv AS (SELECT d.* FROM v_depth d JOIN lim ON d.snapshot_id = lim.snapshot_id AND d.side = lim.x.side WHERE CASE WHEN d.side = 'ASK' THEN price <= lim.x.l ELSE price >= lim.x.l END)"
QUERIES["book_levels_for_price"] = lambda s, d: K.levels_for_price(V.depth(s, d), _limits(s, d)).select("snapshot_id", "side", "level", rnd("price"), "size")
ORACLES["book_levels_for_price"] = f"{DP}, {_lim} SELECT snapshot_id, side, level, {rs('price', 'price')}, size FROM lv"
QUERIES["book_qty_for_price"] = lambda s, d: K.quantity_for_price(V.depth(s, d), _limits(s, d))
ORACLES["book_qty_for_price"] = f"{DP}, {_lim} SELECT snapshot_id, side, sum(size) AS quantity FROM lv GROUP BY 1, 2"
_run = "(PARTITION BY snapshot_id, side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_tk = f"t AS (SELECT *, greatest(least(size, 40 - coalesce(sum(size) OVER {_run}, 0)), 0) AS taken FROM v_depth)"
QUERIES["book_avg_px_for_qty"] = lambda s, d: K.average_price(V.depth(s, d), 40.0).select("snapshot_id", "side", rnd("avg_price"), "filled")
ORACLES["book_avg_px_for_qty"] = f"{DP}, {_tk} SELECT snapshot_id, side, {rs('sum(price * taken) / sum(taken)', 'avg_price')}, sum(taken) AS filled FROM t GROUP BY 1, 2"
QUERIES["book_worst_px_for_qty"] = lambda s, d: K.average_price(V.depth(s, d), 40.0).select("snapshot_id", "side", rnd("worst_price"))
ORACLES["book_worst_px_for_qty"] = f"{DP}, {_tk} SELECT snapshot_id, side, {rs('arg_max(price, level) FILTER (taken > 0)', 'worst_price')} FROM t GROUP BY 1, 2"
_px = f"t AS (SELECT *, floor(greatest(least(price * size, 5000 - coalesce(sum(price * size) OVER {_run}, 0)), 0) / price / 0.01::DOUBLE + 1e-9) * 0.01::DOUBLE AS taken FROM v_depth)"
QUERIES["book_px_for_exposure"] = lambda s, d: K.price_for_exposure(V.depth(s, d), 5000.0).select("snapshot_id", "side", rnd("avg_price"), rnd("quantity"), rnd("final_price"))
ORACLES["book_px_for_exposure"] = f"{DP}, {_px} SELECT snapshot_id, side, {rs('sum(price * taken) / sum(taken)', 'avg_price')}, {rs('sum(taken)', 'quantity')}, {rs('coalesce(arg_max(price, level) FILTER (taken > 0), arg_min(price, level))', 'final_price')} FROM t GROUP BY 1, 2"


def _odd_depth(s, d):
    """Every seventh snapshot crossed, every eleventh with its levels doubled."""
    x = V.depth(s, d)
    x = x.withColumn("price", F.when((F.col("snapshot_id") % 7 == 0) & (F.col("side") == "BID"), F.col("price") + 1).otherwise(F.col("price")))
    return x.unionByName(x.where("snapshot_id % 11 = 0").withColumn("level", F.col("level") + 10))


QUERIES["book_integrity"] = lambda s, d: K.integrity(_odd_depth(s, d), 15).select("snapshot_id", rnd("bid"), rnd("ask"), "levels", "crossed", "too_deep")
ORACLES["book_integrity"] = f"""{DP}, o AS (SELECT snapshot_id, side, level, CASE WHEN snapshot_id % 7 = 0 AND side = 'BID' THEN price + 1 ELSE price END AS price FROM v_depth), u AS (SELECT * FROM o UNION ALL SELECT snapshot_id, side, level + 10, price FROM o WHERE snapshot_id % 11 = 0),
  g AS (SELECT snapshot_id, max(price) FILTER (side = 'BID') AS bid, min(price) FILTER (side = 'ASK') AS ask, greatest(count(*) FILTER (side = 'BID'), count(*) FILTER (side = 'ASK')) AS levels FROM u GROUP BY 1)
  SELECT snapshot_id, {rs('bid', 'bid')}, {rs('ask', 'ask')}, levels, bid > ask AS crossed, levels > 15 AS too_deep FROM g WHERE bid > ask OR levels > 15"""


def _greeks(s, d):
    x = V.table(s, d, "lineitem")
    return x.select((F.col("l_suppkey") % 20).alias("book"), F.col("l_quantity").alias("quantity"), F.lit(100.0).alias("multiplier"), (F.col("l_discount") * 10 - 0.5).alias("delta"), F.col("l_tax").alias("gamma"), (F.col("l_tax") * 2).alias("vega"), (-F.col("l_discount")).alias("theta"), (F.col("l_extendedprice") / 1000).alias("pnl"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


QUERIES["portfolio_greeks"] = lambda s, d: K.portfolio_greeks(_greeks(s, d), "book").select("book", *(F.round(F.col(g) + 1.3e-4, 2).alias(g) for g in K.GREEKS))
_gk = {"delta": "l_discount * 10 - 0.5::DOUBLE", "gamma": "l_tax", "vega": "l_tax * 2", "theta": "-l_discount", "pnl": "l_extendedprice / 1000", "price": "l_extendedprice / l_quantity"}
ORACLES["portfolio_greeks"] = f"SELECT l_suppkey % 20 AS book, {', '.join(f'round(sum(l_quantity * 100 * ({e})) + 1.3e-4, 2) AS {g}' for g, e in _gk.items())} FROM lineitem GROUP BY 1"


def _strikes(s, d):
    p = V.table(s, d, "part").select(F.col("p_brand").alias("series"), F.floor("p_retailprice").cast("double").alias("strike")).distinct()
    return p.withColumn("atm", F.lit(1200.5))


_st = "st AS (SELECT DISTINCT p_brand AS series, floor(p_retailprice)::DOUBLE AS strike, 1200.5::DOUBLE AS atm FROM part)"
QUERIES["option_strike_select"] = lambda s, d: K.strikes_near(_strikes(s, d), 3, 2)
ORACLES["option_strike_select"] = f"WITH {_st}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY strike) AS k FROM st), a AS (SELECT series, arg_min(k, struct_pack(a := abs(strike - atm), b := strike)) AS c FROM k GROUP BY 1) SELECT series, strike, atm FROM k JOIN a USING (series) WHERE k BETWEEN c - 2 AND c + 3"
QUERIES["option_strike_percent"] = lambda s, d: K.strikes_within(_strikes(s, d), 0.2)
ORACLES["option_strike_percent"] = f"WITH {_st} SELECT * FROM st WHERE abs((strike - atm) / atm) <= 0.2::DOUBLE"


def _options(s, d):
    q = V.quotes(s, d)
    return q.select(F.col("instrument_id").alias("series"), (F.floor(F.col("bid_price") / 50) * 50).cast("double").alias("strike"), F.when(F.col("seq") % 3 == 0, "PUT").otherwise("CALL").alias("kind"), "event_time_ns", "seq", F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"))


QUERIES["option_chain_pivot"] = lambda s, d: K.option_chain(_options(s, d)).select("series", "strike", *(rnd(f"{k}_{c}") for k in ("call", "put") for c in ("bid", "ask")))
_oc = lambda k, c: rs(f"arg_max({c}_price, struct_pack(a := event_time_ns, b := seq)) FILTER ((seq % 3 = 0) = {k == 'put'})", f"{k}_{c}")
ORACLES["option_chain_pivot"] = f"WITH {V.sql('v_quotes')} SELECT instrument_id AS series, (floor(bid_price / 50) * 50)::DOUBLE AS strike, {', '.join(_oc(k, c) for k in ('call', 'put') for c in ('bid', 'ask'))} FROM v_quotes GROUP BY 1, 2"


def _swaps(s, d):
    t = V.trades(s, d)
    return t.select(F.col("instrument_id").alias("pool"), F.floor(F.col("seq") / 10).alias("block"), (F.col("seq") % 10).alias("tx"), F.lit(0).alias("log"), F.col("price").alias("spot_price"), (F.col("price") * 1.003).alias("execution_price"))


QUERIES["swap_impact_slippage"] = lambda s, d: K.swap_impact(_swaps(s, d)).select("pool", "block", "tx", F.col("impact_bps").cast("long").alias("impact_bps"), F.col("slippage_bps").cast("long").alias("slippage_bps"))
_sw = lambda e: f"round(abs(({e} - b) / nullif(b, 0)) * 10000)::BIGINT"
ORACLES["swap_impact_slippage"] = f"WITH {V.sql('v_trades')}, w AS (SELECT instrument_id AS pool, seq // 10 AS block, seq % 10 AS tx, price, lag(price) OVER (PARTITION BY instrument_id ORDER BY seq) AS b FROM v_trades) SELECT pool, block, tx, {_sw('price')} AS impact_bps, {_sw('price * 1.003::DOUBLE')} AS slippage_bps FROM w"


def _funding(s, d):
    t = V.trades(s, d)
    rates = V.bars(s, d, 8 * HOUR).select("instrument_id", "event_time_ns", "seq", (F.col("volume") % 7 / 10000).alias("rate"))
    return K.funding_cost(t.select(*KEYS, "quantity", "price"), rates).select(*KEYS, F.round(F.col("funding_rate"), 8).alias("funding_rate"), rnd("funding_cost"))


QUERIES["funding_cost"] = _funding
ORACLES["funding_cost"] = f"WITH {V.sql('v_trades')}, r AS (SELECT instrument_id, event_time_ns // {8 * HOUR} * {8 * HOUR} AS event_time_ns, sum(quantity) % 7 / 10000 AS rate FROM v_trades GROUP BY 1, 2) SELECT t.instrument_id, t.event_time_ns, t.seq, round(r.rate, 8) AS funding_rate, {rs('t.quantity * t.price * r.rate', 'funding_cost')} FROM v_trades t ASOF LEFT JOIN r ON t.instrument_id = r.instrument_id AND t.event_time_ns >= r.event_time_ns"

# Signals
BASE = f"WITH {V.sql('v_bars')}"
QUERIES["sig_cross_over_under"] = lambda s, d: G.crosses(V.bars(s, d), "close", 150.0).select(*KEYS, "cross_over", "cross_under")
_lg = f"lag(close) OVER ({LINE})"
ORACLES["sig_cross_over_under"] = f"{BASE} SELECT instrument_id, event_time_ns, seq, coalesce({_lg} <= 150 AND close > 150, false) AS cross_over, coalesce({_lg} >= 150 AND close < 150, false) AS cross_under FROM v_bars"
_mac = f"m AS (SELECT *, {full('avg', 'close', 10)} AS f, {full('avg', 'close', 30)} AS s FROM v_bars), g AS (SELECT *, lag(f) OVER ({LINE}) AS pf, lag(s) OVER ({LINE}) AS ps FROM m), sg AS (SELECT *, CASE WHEN pf <= ps AND f > s THEN 'BUY' WHEN pf >= ps AND f < s THEN 'SELL' ELSE 'HOLD' END AS signal FROM g)"
QUERIES["sig_ma_crossover"] = lambda s, d: G.ma_crossover(V.bars(s, d)).select(*KEYS, "signal")
ORACLES["sig_ma_crossover"] = f"{BASE}, {_mac} SELECT instrument_id, event_time_ns, seq, signal FROM sg"
QUERIES["sig_to_intent"] = lambda s, d: G.to_intent(G.ma_crossover(V.bars(s, d))).select(*KEYS, "signal", "intent", "side", "target", "quantity")
ORACLES["sig_to_intent"] = f"{BASE}, {_mac} SELECT instrument_id, event_time_ns, seq, signal, CASE signal WHEN 'BUY' THEN 'order' ELSE 'position' END AS intent, CASE signal WHEN 'BUY' THEN 'BUY' END AS side, CASE signal WHEN 'SELL' THEN 'FLAT' END AS target, CASE signal WHEN 'BUY' THEN 1.0::DOUBLE END AS quantity FROM sg WHERE signal <> 'HOLD'"
QUERIES["sig_trend_breakout_atr"] = lambda s, d: G.trend_breakout(V.bars(s, d)).select(*KEYS, "signal", "reason")
_full_p = lambda agg, x, n: f"CASE WHEN {P(f'count({x})', n)} >= {n} THEN {P(f'{agg}({x})', n)} END"


def _breakout_sql() -> str:
    ready = "(n.u IS NOT NULL AND n.l IS NOT NULL AND n.t IS NOT NULL AND n.a IS NOT NULL)"
    best = "CASE WHEN r.side = 1 THEN greatest(r.best, n.close) ELSE least(r.best, n.close) END"
    lx = f"CASE WHEN n.close <= r.entry - 2 * n.a THEN 'long_exit_stop' WHEN n.close <= {best} - 3 * n.a THEN 'long_exit_giveback' WHEN n.close < n.t THEN 'long_exit_trend' WHEN n.close < n.l THEN 'long_exit_breakout' END"
    sx = f"CASE WHEN n.close >= r.entry + 2 * n.a THEN 'short_exit_stop' WHEN n.close >= {best} + 3 * n.a THEN 'short_exit_giveback' WHEN n.close > n.t THEN 'short_exit_trend' WHEN n.close > n.u THEN 'short_exit_breakout' END"
    lively = "(n.close > 0 AND n.a / n.close >= 0.001)"
    reason = f"""CASE WHEN NOT {ready} THEN 'warmup_hold' WHEN r.side = 1 THEN coalesce({lx}, 'hold_long') WHEN r.side = -1 THEN coalesce({sx}, 'hold_short') WHEN r.pause > 0 THEN 'cooldown_hold'
      WHEN n.close > n.u AND n.close < n.l THEN 'ambiguous_hold' WHEN n.close > n.u AND n.close > n.t AND {lively} THEN 'long_breakout' WHEN n.close < n.l AND n.close < n.t AND {lively} THEN 'short_breakout' WHEN NOT {lively} THEN 'low_volatility_hold' ELSE 'no_signal' END"""
    return f"""WITH RECURSIVE {V.sql('v_bars')}, a AS (SELECT *, {EXPR['true_range']} AS true_range, row_number() OVER ({LINE}) AS k FROM v_bars),
  n AS (SELECT *, {_full_p('max', 'high', 20)} AS u, {_full_p('min', 'low', 20)} AS l, {full('avg', 'close', 50)} AS t, {full('avg', 'true_range', 14)} AS a FROM a),
  r AS (SELECT k, instrument_id, event_time_ns, seq, 'warmup_hold' AS reason, 0 AS side, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS best, 0 AS pause FROM n WHERE k = 1
    UNION ALL SELECT k, instrument_id, event_time_ns, seq, reason, CASE WHEN reason = 'long_breakout' THEN 1 WHEN reason = 'short_breakout' THEN -1 WHEN reason LIKE '%exit%' THEN 0 ELSE side END,
      CASE WHEN reason LIKE '%t_breakout' OR reason = 'long_breakout' THEN close ELSE entry END, CASE WHEN reason IN ('long_breakout', 'short_breakout') THEN close ELSE nb END,
      CASE WHEN reason LIKE '%exit%' THEN 3 WHEN reason = 'cooldown_hold' THEN pause - 1 ELSE pause END
    FROM (SELECT n.k, n.instrument_id, n.event_time_ns, n.seq, n.close, r.side, r.entry, r.pause, {best} AS nb, {reason} AS reason FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1))
  SELECT instrument_id, event_time_ns, seq, reason, CASE WHEN reason IN ('long_breakout') OR reason LIKE 'short_exit%' THEN 'BUY' WHEN reason = 'short_breakout' OR reason LIKE 'long_exit%' THEN 'SELL' ELSE 'HOLD' END AS signal FROM r"""


ORACLES["sig_trend_breakout_atr"] = _breakout_sql()
QUERIES["sig_vwm_short"] = lambda s, d: G.vwm_short(V.bars(s, d)).select(*KEYS, rnd("entry_price"), "reason")
_past = "OVER (PARTITION BY instrument_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_next = "OVER (PARTITION BY instrument_id ORDER BY k)"
ORACLES["sig_vwm_short"] = f"""{SETUP},
  b AS (SELECT *, coalesce(prev_vwm <= 0 AND vwm > 0, false) AS bull, coalesce(prev_vwm >= 0 AND vwm < 0, false) AS bear FROM s),
  t AS (SELECT *, last_value(CASE WHEN bear THEN k END IGNORE NULLS) {_past} AS mk, last_value(CASE WHEN bear THEN close END IGNORE NULLS) {_past} AS mc, lag(bull) {_next} AS was_bull, lag(atr) {_next} AS prev_atr FROM b),
  u AS (SELECT *, CASE WHEN k > 20 AND momentum IS NOT NULL THEN mc - 0.5::DOUBLE * prev_atr END AS trigger, coalesce(volume > 0 AND k - 1 - coalesce(mk, 0) <= 5 AND NOT bear, false) AS is_open FROM t),
  v AS (SELECT k, instrument_id, event_time_ns, seq, NULL::DOUBLE AS entry_price, NULL::VARCHAR AS reason, false AS short FROM u WHERE k = 1
    UNION ALL SELECT k, instrument_id, event_time_ns, seq, entry_price, CASE WHEN enters THEN 'enter_short' WHEN leaves THEN 'exit_short' END, CASE WHEN enters THEN true WHEN leaves THEN false ELSE short END
    FROM (SELECT u.k, u.instrument_id, u.event_time_ns, u.seq, v.short, CASE WHEN u.is_open AND NOT v.short THEN u.trigger END AS entry_price,
      coalesce(NOT v.short AND u.is_open AND u.low <= u.trigger, false) AS enters, coalesce(v.short AND u.volume > 0 AND u.was_bull, false) AS leaves FROM v JOIN u ON u.instrument_id = v.instrument_id AND u.k = v.k + 1))
  SELECT instrument_id, event_time_ns, seq, {rs('entry_price', 'entry_price')}, reason FROM v"""
QUERIES["sizing_notional"] = lambda s, d: G.size_notional(V.bars(s, d), 10_000.0).select("instrument_id", rnd("price"), rnd("quantity"))
_first = "arg_min(close, event_time_ns)"
ORACLES["sizing_notional"] = f"{BASE} SELECT instrument_id, {rs(_first, 'price')}, {rs(f'10000.0::DOUBLE / {_first}', 'quantity')} FROM v_bars GROUP BY 1"
QUERIES["sizing_vol_target"] = lambda s, d: G.size_vol_target(V.bars(s, d), 100.0, 100.0, 270.0).select("instrument_id", rnd("price"), rnd("quantity"), "status")
ORACLES["sizing_vol_target"] = f"""{BASE}, l AS (SELECT *, {EXPR['log_return']} AS lr FROM v_bars), g AS (SELECT instrument_id, {_first} AS p, 100.0::DOUBLE / stddev_pop(lr) AS w FROM l GROUP BY 1)
  SELECT instrument_id, {rs('p', 'price')}, {rs('greatest(least(w, 270), 100) / p', 'quantity')}, CASE WHEN w > 270 THEN 'max_cap' WHEN w < 100 THEN 'min_cap' ELSE 'ok' END AS status FROM g"""
