"""Queries of bar aggregation and of views on ticks with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import bars as B
from marketloom.plans import views as V
from marketloom.plans.q_features import LINE, NUDGE
from marketloom.schemas import HOUR

QUERIES, ORACLES = {}, {}
OHLCV = ("open", "high", "low", "close", "volume")
_ST = "struct_pack(a := event_time_ns, b := seq)"


def ohlcv_sql(size: str, extra: str = "") -> str:
    return f"""round(arg_min(price, {_ST}) + {NUDGE}, 6) AS open, round(max(price) + {NUDGE}, 6) AS high, round(min(price) + {NUDGE}, 6) AS low,
    round(arg_max(price, {_ST}) + {NUDGE}, 6) AS close, round(sum({size}) + {NUDGE}, 6) AS volume{extra}"""


def rounded(df, keys, cols=OHLCV):
    return df.select(*keys, *(F.round(F.col(c).cast("double") + NUDGE, 6).alias(c) for c in cols))


QUERIES["bars_time"] = lambda s, d: rounded(B.time_bars(V.trades(s, d), HOUR), ["instrument_id", "event_time_ns", "trade_count", "volume_is_synthetic", F.col("trading_date").cast("string").alias("trading_date")], (*OHLCV, "quote_volume"))
ORACLES["bars_time"] = f"""WITH {V.sql('v_trades')} SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns, count(*) AS trade_count, count(quantity) = 0 AS volume_is_synthetic,
  strftime(make_timestamp(event_time_ns // {HOUR} * {HOUR} // 1000), '%Y-%m-%d') AS trading_date, {ohlcv_sql('quantity', f', round(sum(price * quantity) + {NUDGE}, 6) AS quote_volume')} FROM v_trades GROUP BY 1, 2, 5"""
_4H = 4 * HOUR
QUERIES["bars_resample"] = lambda s, d: rounded(B.resample(V.bars(s, d), _4H), ["instrument_id", "event_time_ns"])
ORACLES["bars_resample"] = f"""WITH {V.sql('v_bars')} SELECT instrument_id, event_time_ns // {_4H} * {_4H} AS event_time_ns, round(arg_min(open, event_time_ns) + {NUDGE}, 6) AS open,
  round(max(high) + {NUDGE}, 6) AS high, round(min(low) + {NUDGE}, 6) AS low, round(arg_max(close, event_time_ns) + {NUDGE}, 6) AS close, round(sum(volume) + {NUDGE}, 6) AS volume FROM v_bars GROUP BY 1, 2"""
QUERIES["bars_quote_mid"] = lambda s, d: rounded(B.quote_mid_bars(V.quotes(s, d), HOUR), ["instrument_id", "event_time_ns"])
ORACLES["bars_quote_mid"] = f"WITH {V.sql('v_quotes')}, m AS (SELECT *, (bid_price + ask_price) / 2 AS price FROM v_quotes) SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns, {ohlcv_sql('1')} FROM m GROUP BY 1, 2"
QUERIES["bars_interval_type"] = lambda s, d: rounded(B.calendar_bars(V.trades(s, d), "week"), ["instrument_id", "event_time_ns", "start_ns"])
_wk = "CAST(epoch_us(date_trunc('week', make_timestamp((event_time_ns - 1) // 1000))) * 1000 AS BIGINT)"
ORACLES["bars_interval_type"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, {_wk} + 604800000000000 AS event_time_ns, {_wk} AS start_ns, {ohlcv_sql('quantity')} FROM v_trades GROUP BY 1, 2, 3"
QUERIES["bars_month"] = lambda s, d: rounded(B.calendar_bars(V.trades(s, d), "month", left_open=False, stamp_close=False), ["instrument_id", "event_time_ns", "end_ns"])
_mo = "date_trunc('month', make_timestamp(event_time_ns // 1000))"
ORACLES["bars_month"] = f"WITH {V.sql('v_trades')} SELECT instrument_id, epoch_us({_mo}) * 1000 AS event_time_ns, epoch_us({_mo} + INTERVAL 1 MONTH) * 1000 AS end_ns, {ohlcv_sql('quantity')} FROM v_trades GROUP BY 1, 2, 3"
QUERIES["bars_fill_empty"] = lambda s, d: rounded(B.fill_empty(V.bars(s, d), HOUR), ["instrument_id", "event_time_ns", "is_empty"])
ORACLES["bars_fill_empty"] = f"""WITH {V.sql('v_bars')}, e AS (SELECT instrument_id, min(event_time_ns) AS a, max(event_time_ns) AS b FROM v_bars GROUP BY 1),
  c AS (SELECT instrument_id, unnest(range(a, b + 1, {HOUR})) AS event_time_ns FROM e),
  j AS (SELECT c.*, v.open, v.high, v.low, v.close, v.volume, last_value(v.close IGNORE NULLS) OVER (PARTITION BY c.instrument_id ORDER BY c.event_time_ns ROWS UNBOUNDED PRECEDING) AS lc
    FROM c LEFT JOIN v_bars v ON v.instrument_id = c.instrument_id AND v.event_time_ns = c.event_time_ns)
  SELECT instrument_id, event_time_ns, open IS NULL AS is_empty, {', '.join(f'round(coalesce({c}, lc) + {NUDGE}, 6) AS {c}' for c in ('open', 'high', 'low', 'close'))}, round(coalesce(volume, 0) + {NUDGE}, 6) AS volume FROM j"""
_NB = ["instrument_id", "bar", "event_time_ns", "tick_count"]
_TAIL = ", count(*) AS tick_count, max(event_time_ns) AS event_time_ns"
QUERIES["bars_tick"] = lambda s, d: rounded(B.tick_bars(V.trades(s, d), 25), _NB)
ORACLES["bars_tick"] = f"WITH {V.sql('v_trades')}, n AS (SELECT *, (row_number() OVER ({LINE}) - 1) // 25 AS bar FROM v_trades) SELECT instrument_id, bar, {ohlcv_sql('quantity', _TAIL)} FROM n GROUP BY 1, 2"


def amount_sql(amount: str, step: str, size: str) -> str:
    return f"""WITH {V.sql('v_trades')}, a AS (SELECT *, {amount} AS amount FROM v_trades WHERE {amount} > 0),
  c AS (SELECT *, sum(amount) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS upto FROM a),
  x AS (SELECT *, unnest(range(CAST(floor((upto - amount) / {step}) AS BIGINT), greatest(CAST(floor((upto - amount) / {step}) AS BIGINT) + 1, CAST(ceil(upto / {step}) AS BIGINT)))) AS bar FROM c),
  p AS (SELECT *, least(upto, (bar + 1) * {step}) - greatest(upto - amount, bar * {step}) AS part FROM x)
  SELECT instrument_id, bar, {ohlcv_sql(size, _TAIL)} FROM p GROUP BY 1, 2"""


QUERIES["bars_volume"] = lambda s, d: rounded(B.amount_bars(V.trades(s, d), 1000.0), _NB)
ORACLES["bars_volume"] = amount_sql("quantity", "1000.0::DOUBLE", "part")
QUERIES["bars_value"] = lambda s, d: rounded(B.amount_bars(V.trades(s, d), 99999.0, notional=True), _NB)
# values in whole billionths, as in the operator: a running sum of doubles depends on how it is summed
_VS = 99999 * 10**9
ORACLES["bars_value"] = f"""WITH {V.sql('v_trades')}, a AS (SELECT *, round(price * quantity * 1e9)::BIGINT AS amount FROM v_trades WHERE price * quantity > 0),
  c AS (SELECT *, sum(amount) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS upto FROM a),
  x AS (SELECT *, unnest(range(CAST((upto - amount) // {_VS} AS BIGINT), greatest(CAST((upto - amount) // {_VS} AS BIGINT), CAST((upto - 1) // {_VS} AS BIGINT)) + 1)) AS bar FROM c),
  p AS (SELECT *, (least(upto, (bar + 1)::HUGEINT * {_VS}) - greatest(upto - amount, bar::HUGEINT * {_VS}))::DOUBLE / 1e9 AS part FROM x)
  SELECT instrument_id, bar, {ohlcv_sql('part / price', _TAIL)} FROM p GROUP BY 1, 2"""


def signed_sql(weight: str, step: float, runs: bool) -> str:
    held = "(CASE WHEN r.closed THEN 0 ELSE r.held END)"
    if runs:
        held = f"(CASE WHEN {held} * n.x < 0 THEN 0 ELSE {held} END)"
    return f"""WITH RECURSIVE {V.sql('v_trades')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k, {weight} * (CASE WHEN side = 'BUY' THEN 1 ELSE -1 END)::DOUBLE AS x FROM v_trades),
  r AS (SELECT instrument_id, k, x AS held, abs(x) >= {step} AS closed, 0::BIGINT AS bar FROM n WHERE k = 1
    UNION ALL SELECT n.instrument_id, n.k, {held} + n.x, abs({held} + n.x) >= {step}, r.bar + r.closed::BIGINT FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1)
  SELECT n.instrument_id, bar, {ohlcv_sql('quantity', _TAIL)} FROM n JOIN r ON n.instrument_id = r.instrument_id AND n.k = r.k GROUP BY 1, 2"""


for _kind, _w, _step in (("tick", "1", 5.0), ("volume", "quantity", 301.5), ("value", "price * quantity", 60000.5)):
    for _runs in (False, True):
        _name = f"bars_{_kind}_{'runs' if _runs else 'imbalance'}"
        QUERIES[_name] = lambda s, d, k=_kind, st=_step, r=_runs: rounded(B.signed_bars(V.trades(s, d), st, k, r), _NB)
        ORACLES[_name] = signed_sql(_w, _step, _runs)


QUERIES["bars_renko"] = lambda s, d: rounded(B.renko(V.trades(s, d), 25.3), ["instrument_id", "brick", "event_time_ns", "direction"], ("open", "close"))
ORACLES["bars_renko"] = f"""WITH RECURSIVE {V.sql('v_trades')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k FROM v_trades),
  r AS (SELECT instrument_id, k, event_time_ns, price AS base, price AS last, 0::BIGINT AS made, 0::BIGINT AS total FROM n WHERE k = 1
    UNION ALL SELECT n.instrument_id, n.k, n.event_time_ns, r.last, r.last + sign(n.price - r.last) * 25.3::DOUBLE * floor((abs(n.price - r.last) + 1e-9) / 25.3::DOUBLE),
      floor((abs(n.price - r.last) + 1e-9) / 25.3::DOUBLE)::BIGINT, r.total + r.made FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1),
  x AS (SELECT *, unnest(range(made)) AS j FROM r WHERE made > 0)
  SELECT instrument_id, total + j AS brick, event_time_ns, sign(last - base)::INT AS direction,
    round(base + sign(last - base) * 25.3::DOUBLE * j + {NUDGE}, 6) AS open, round(base + sign(last - base) * 25.3::DOUBLE * (j + 1) + {NUDGE}, 6) AS close FROM x"""
_RH = 24 * HOUR * 7


def _rolls(s, d):
    """A roll each week, from the week's first trade."""
    w = V.trades(s, d).groupBy("instrument_id", idiv(F.col("event_time_ns"), _RH).alias("w")).agg(F.min("event_time_ns").alias("roll_time_ns"))
    return w.select("instrument_id", "roll_time_ns", (F.lit(1.0) + (F.col("w") % 5) / 100).alias("factor"))


QUERIES["bars_adjusted"] = lambda s, d: B.adjust(V.trades(s, d), _rolls(s, d)).select("instrument_id", "event_time_ns", "seq", F.round(F.col("adjusted_price") + NUDGE, 6).alias("adjusted_price"))
ORACLES["bars_adjusted"] = f"""WITH {V.sql('v_trades')}, w AS (SELECT instrument_id, event_time_ns // {_RH} AS w, min(event_time_ns) AS rolled FROM v_trades GROUP BY 1, 2),
  r AS (SELECT instrument_id, rolled, 1.0::DOUBLE + (w % 5) / 100.0::DOUBLE AS factor FROM w)
  SELECT t.instrument_id, t.event_time_ns, t.seq, round(any_value(t.price) * exp(coalesce(sum(ln(r.factor)), 0)) + {NUDGE}, 6) AS adjusted_price
  FROM v_trades t LEFT JOIN r ON r.instrument_id = t.instrument_id AND r.rolled > t.event_time_ns GROUP BY 1, 2, 3"""
QUERIES["spread_quotes"] = lambda s, d: rounded(B.spread_quotes(V.quotes(s, d), [("I0", 1.0), ("I1", -0.5)], "I0-I1"), ["instrument_id", "event_time_ns", "seq"], ("bid_price", "ask_price"))
ORACLES["spread_quotes"] = f"""WITH {V.sql('v_quotes')}, q AS (SELECT event_time_ns, seq, last_value(CASE WHEN instrument_id = 'I0' THEN bid_price END IGNORE NULLS) OVER w AS b0, last_value(CASE WHEN instrument_id = 'I0' THEN ask_price END IGNORE NULLS) OVER w AS a0,
  last_value(CASE WHEN instrument_id = 'I1' THEN bid_price END IGNORE NULLS) OVER w AS b1, last_value(CASE WHEN instrument_id = 'I1' THEN ask_price END IGNORE NULLS) OVER w AS a1
  FROM v_quotes WHERE instrument_id IN ('I0', 'I1') WINDOW w AS (ORDER BY event_time_ns, seq ROWS UNBOUNDED PRECEDING))
  SELECT 'I0-I1' AS instrument_id, event_time_ns, seq, round(b0 - 0.5::DOUBLE * a1 + {NUDGE}, 6) AS bid_price, round(a0 - 0.5::DOUBLE * b1 + {NUDGE}, 6) AS ask_price FROM q WHERE b0 IS NOT NULL AND b1 IS NOT NULL"""
