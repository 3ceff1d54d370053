"""Streaming queries: each replays derived trades as a stream to its end, and reads what it wrote."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketloom.functions.features import REGISTRY
from marketloom.functions.ints import idiv
from marketloom.operators import scan
from marketloom.plans import views as V
from marketloom.plans.q_bars import ohlcv_sql
from marketloom.plans.q_features import KEYS, LINE, NUDGE, feature_sql, rounded
from marketloom.plans.q_sources import place
from marketloom.schemas import HOUR
from marketloom.streaming import streams as S
from marketloom.streaming.feature_stream import FeatureStream, differences

QUERIES, ORACLES = {}, {}
TR = f"WITH {V.sql('v_trades')}"
rnd = lambda c: F.round(F.col(c) + NUDGE, 6).alias(c)


#: Files of one part of a replay; a micro-batch reads as many.
FILES = 4


def _parts(s, rows, conditions):
    """Rows in files written one part after the other, as a replay reads them by age."""
    path = place(s)
    for c in conditions:
        rows.where(c).repartition(FILES).write.mode("append").parquet(path)
    return path, rows.schema, FILES


def _stored(s, d, parts: int = 4):
    t = V.trades(s, d)
    first, last = t.agg(F.min("event_time_ns"), F.max("event_time_ns")).first()
    cuts = [first + (last + 1 - first) * k // parts for k in range(parts + 1)]
    return _parts(s, t, [(F.col("event_time_ns") >= a) & (F.col("event_time_ns") < b) for a, b in zip(cuts, cuts[1:])])


def _state_store(s):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _files(s, stream):
    out = place(s)
    _state_store(s)
    S.run_to_files(stream, out, place(s))
    return s.read.parquet(out)


QUERIES["stream_source_replay"] = lambda s, d: _files(s, S.replay(s, *_stored(s, d))).select(*KEYS, rnd("price"))
ORACLES["stream_source_replay"] = f"{TR} SELECT instrument_id, event_time_ns, seq, round(price + {NUDGE}, 6) AS price FROM v_trades"


def _bars(s, d):
    out = place(s)
    _state_store(s)
    S.run_to_snapshot(S.bars(S.replay(s, *_stored(s, d)), "1 hour", None), out, place(s))
    return s.read.parquet(out).select("instrument_id", "event_time_ns", *map(rnd, ("open", "high", "low", "close", "volume")))


QUERIES["stream_bars"] = _bars
ORACLES["stream_bars"] = f"{TR} SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns, {ohlcv_sql('quantity')} FROM v_trades GROUP BY 1, 2"


def _final(s, d):
    """Bars that the watermark has closed: all but the last hours of the stream."""
    out = _files(s, S.bars(S.replay(s, *_stored(s, d)), "1 hour"))
    edge = V.trades(s, d).agg(F.max("event_time_ns").alias("m"))
    return out.join(F.broadcast(edge), F.col("event_time_ns") + 3 * HOUR < F.col("m")).select("instrument_id", "event_time_ns", *map(rnd, ("open", "high", "low", "close", "volume")))


QUERIES["stream_window_finalize"] = _final
ORACLES["stream_window_finalize"] = f"{TR}, e AS (SELECT max(event_time_ns) AS m FROM v_trades) SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns, {ohlcv_sql('quantity')} FROM v_trades, e WHERE event_time_ns // {HOUR} * {HOUR} + {3 * HOUR} < m GROUP BY 1, 2"
CUT = 1705500000 * 10**9


def _watermark(s, d):
    """Two sources of each instrument: one sends its newer half first, the other comes in order."""
    t = V.trades(s, d).withColumn("kind", F.lit("trade")).withColumnRenamed("side", "source")
    early = (F.col("source") == "BUY") == (F.col("event_time_ns") >= CUT)
    out = _files(s, S.watermarks(S.replay(s, *_parts(s, t, [early, ~early]))))
    return out.groupBy(*S.STREAM).agg(F.count("*").alias("n"), F.sum(F.col("is_late").cast("long")).alias("late"), F.max("watermark_ns").alias("watermark_ns"))


QUERIES["stream_watermark"] = _watermark
ORACLES["stream_watermark"] = f"""{TR}, a AS (SELECT *, CASE WHEN (side = 'BUY') = (event_time_ns >= {CUT}) THEN 0 ELSE 1 END AS part FROM v_trades),
  w AS (SELECT *, max(event_time_ns) OVER (PARTITION BY instrument_id, side ORDER BY part, event_time_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM a)
  SELECT instrument_id, 'trade' AS kind, side AS source, count(*) AS n, sum(CASE WHEN event_time_ns < high - 60000000000 THEN 1 ELSE 0 END) AS late, max(event_time_ns) - 60000000000 AS watermark_ns FROM w GROUP BY 1, 2, 3"""


def _dedup(s, d):
    t = S.replay(s, *_stored(s, d))
    twice = t.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _files(s, S.dedup(twice, ["instrument_id", "seq"])).select(*KEYS, rnd("price"))


QUERIES["stream_dedup"], ORACLES["stream_dedup"] = _dedup, ORACLES["stream_source_replay"]


def _json(s, d):
    t = V.trades(s, d)
    trade = F.struct(F.when(F.col("seq") % 9 == 0, "other").otherwise("aggTrade").alias("e"), idiv("event_time_ns", 10**6).alias("E"), F.when(F.col("seq") % 4 != 0, idiv("event_time_ns", 10**6) - 5).alias("T"), F.col("instrument_id").alias("s"), F.col("seq").alias("a"), F.col("price").cast("string").alias("p"), F.col("quantity").cast("string").alias("q"), (F.col("side") == "SELL").alias("m"))
    raw = t.select(F.to_json(trade).alias("json"), F.col("event_time_ns").alias("receive_time_ns"))
    return S.normalize_json(raw).select("kind", *KEYS, rnd("price"), rnd("quantity"), "side")


QUERIES["stream_normalize_json"] = _json
ORACLES["stream_normalize_json"] = f"{TR} SELECT 'trade' AS kind, instrument_id, (event_time_ns // 1000000 - CASE WHEN seq % 4 <> 0 THEN 5 ELSE 0 END) * 1000000 AS event_time_ns, seq, round(price + {NUDGE}, 6) AS price, round(quantity + {NUDGE}, 6) AS quantity, side FROM v_trades WHERE seq % 9 <> 0"


def _features(s, stored, **how):
    return _files(s, S.features(S.replay(s, *stored), **how))


STREAMED = ["trade_volume_sum", "avg_trade_size", "trade_quote_volume_sum", "trade_vwap", "signed_trade_volume", "trade_imbalance", "large_trade_ratio"]


def _stream_features(s, d):
    """Trade features and an exponential mean with what builds on it, from the registry."""
    path, schema, files = _stored(s, d)
    stream = FeatureStream([*STREAMED, "ewma_price", "ewma_price_gap"], place(s))
    stream.run(S.replay(s, path, schema, files).drop("ts"), place(s))
    return rounded(stream.read(s, schema), stream.names)


QUERIES["stream_features"] = _stream_features
_ema = "r.e + (2.0::DOUBLE / 11) * (n.price - r.e)"
ORACLES["stream_features"] = f"""WITH RECURSIVE {V.sql('v_trades')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k FROM v_trades),
  r AS (SELECT instrument_id, k, price AS e FROM n WHERE k = 1 UNION ALL SELECT n.instrument_id, n.k, {_ema} FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1),
  f AS ({feature_sql(STREAMED, 'v_trades')})
  SELECT f.*, round(e + {NUDGE}, 6) AS ewma_price, round(price / e - 1 + {NUDGE}, 6) AS ewma_price_gap FROM n JOIN r ON n.instrument_id = r.instrument_id AND n.k = r.k JOIN f ON f.instrument_id = n.instrument_id AND f.event_time_ns = n.event_time_ns AND f.seq = n.seq"""


#: How late trades of the containers' stream come.
LATE = 6 * HOUR


def _containers(s, d):
    """Every fifth trade comes hours late, every seventh twice; heartbeats close the stream."""
    t = V.trades(s, d)
    first, last = t.agg(F.min("event_time_ns"), F.max("event_time_ns")).first()
    ends = t.groupBy("instrument_id").agg(F.lit(last + LATE).alias("event_time_ns"), F.lit(-1).cast("long").alias("seq"))
    every = t.withColumn("sent", F.when(F.col("seq") % 5 == 0, F.col("event_time_ns") + LATE).otherwise(F.col("event_time_ns")))
    every = every.unionByName(every.where("seq % 7 = 0").withColumn("sent", F.col("sent") + 3 * HOUR)).unionByName(ends.withColumn("sent", F.lit(last + 2 * LATE)), True)
    cuts = [first, *(first + (last - first) * k // 4 for k in (1, 2, 3)), last + 3 * LATE]
    parts = [(F.col("sent") >= x) & (F.col("sent") < y) for x, y in zip(cuts, cuts[1:])]
    out = _files(s, S.containers(S.replay(s, *_parts(s, every, parts)), lateness_ns=LATE))
    return out.select(*KEYS, rnd("ema"), *(F.when(F.col("n") >= 5, F.round(F.col(c) + NUDGE, 6)).alias(c) for c in ("mean_k", "std_k")), rnd("span_sum"), rnd("span_vwap"), "n")


QUERIES["stream_stateful_containers"] = _containers
_span = f"OVER (PARTITION BY instrument_id ORDER BY event_time_ns RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)"
ORACLES["stream_stateful_containers"] = f"""WITH RECURSIVE {V.sql('v_trades')}, n AS (SELECT *, row_number() OVER ({LINE}) AS k, avg(price) OVER ({LINE} ROWS 4 PRECEDING) AS m, stddev_samp(price) OVER ({LINE} ROWS 4 PRECEDING) AS sd,
    sum(price) {_span} AS total, sum(price * quantity) {_span} AS money, sum(quantity) {_span} AS volume FROM v_trades),
  r AS (SELECT instrument_id, k, price AS e FROM n WHERE k = 1 UNION ALL SELECT n.instrument_id, n.k, {_ema} FROM r JOIN n ON n.instrument_id = r.instrument_id AND n.k = r.k + 1)
  SELECT n.instrument_id, event_time_ns, seq, round(e + {NUDGE}, 6) AS ema, CASE WHEN n.k >= 5 THEN round(m + {NUDGE}, 6) END AS mean_k, CASE WHEN n.k >= 5 THEN round(sd + {NUDGE}, 6) END AS std_k,
    round(total + {NUDGE}, 6) AS span_sum, CASE WHEN volume > 0 THEN round(money / volume + {NUDGE}, 6) END AS span_vwap, n.k AS n FROM n JOIN r ON n.instrument_id = r.instrument_id AND n.k = r.k"""
WINDOW = 12 * 24 * HOUR


def _late(s, d):
    """The newer trades first, so that all others come late, under each policy: rows that come
    out, late ones among them, events used, and the mean after the last of these."""
    newer = F.col("event_time_ns") >= CUT
    stored = _parts(s, V.trades(s, d), [newer, ~newer])
    out = None
    for policy, live in [(p, False) for p in S.POLICIES] + [("recompute_for_backtest_only", True)]:
        rows = _features(s, stored, policy=policy, window_ns=WINDOW, live=live).withColumn("policy", F.lit(policy + "_live" * live))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("policy", "instrument_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("is_late").cast("long")).alias("late"), F.max("n").alias("used"), F.round(F.max_by("ema", "n") + NUDGE, 6).alias("ema")
    )


QUERIES["stream_late_policy"] = _late
ORACLES["stream_late_policy"] = f"""WITH RECURSIVE {V.sql('v_trades')}, a AS (SELECT *, event_time_ns < {CUT} AS older, max(event_time_ns) OVER (PARTITION BY instrument_id) AS high FROM v_trades),
  p AS (SELECT unnest(['drop', 'log_only', 'update_if_not_finalized', 'recompute_for_backtest_only', 'recompute_for_backtest_only_live']) AS policy),
  used AS (SELECT policy, instrument_id, older, price, row_number() OVER (PARTITION BY policy, instrument_id ORDER BY older, event_time_ns, seq) AS k FROM a, p
    WHERE NOT older OR policy = 'recompute_for_backtest_only' OR (policy = 'update_if_not_finalized' AND event_time_ns > high - {WINDOW})),
  r AS (SELECT policy, instrument_id, k, price AS e FROM used WHERE k = 1 UNION ALL SELECT n.policy, n.instrument_id, n.k, r.e + (2.0::DOUBLE / 11) * (n.price - r.e) FROM r JOIN used n ON n.policy = r.policy AND n.instrument_id = r.instrument_id AND n.k = r.k + 1),
  u AS (SELECT policy, instrument_id, count(*) AS used, sum(CASE WHEN older THEN 1 ELSE 0 END) AS late FROM used GROUP BY 1, 2),
  l AS (SELECT instrument_id, count(*) AS n_old FROM a WHERE older GROUP BY 1)
  SELECT u.policy, u.instrument_id, used + CASE WHEN u.policy = 'log_only' THEN coalesce(n_old, 0) ELSE 0 END AS n_rows, late + CASE WHEN u.policy = 'log_only' THEN coalesce(n_old, 0) ELSE 0 END AS late, used, round(e + {NUDGE}, 6) AS ema
  FROM u JOIN r ON r.policy = u.policy AND r.instrument_id = u.instrument_id AND r.k = u.used LEFT JOIN l ON l.instrument_id = u.instrument_id"""


PARITY = sorted(f.name for f in REGISTRY.known.values() if f.group in ("bars", "research") and not f.name.endswith("_"))
#: Parts of the parity's stream, and the seed of the places where they are cut.
PARTS, CUT_SEED = 3, 11


def _parity(s, d):
    """For every feature of bars: rows, and rows in which the stream, cut at random places, and
    the batch differ."""
    b = scan.settled(V.bars(s, d))
    first, last = b.agg(F.min("event_time_ns"), F.max("event_time_ns")).first()
    draw = random.Random(CUT_SEED)
    cuts = [first, *sorted(draw.randint(first, last) for _ in range(PARTS - 1)), last + 1]
    path, schema, files = _parts(s, b, [(F.col("event_time_ns") >= x) & (F.col("event_time_ns") < y) for x, y in zip(cuts, cuts[1:])])
    stream = FeatureStream(PARITY, place(s))
    stream.run(S.replay(s, path, schema, files).drop("ts"), place(s))
    return differences(stream.read(s, schema), REGISTRY.compute(b, PARITY), PARITY)


QUERIES["stream_batch_parity"] = _parity
ORACLES["stream_batch_parity"] = f"WITH {V.sql('v_bars')} SELECT feature, n AS rows, 0 AS different FROM (SELECT count(*) AS n FROM v_bars), (SELECT unnest([{', '.join(repr(n) for n in PARITY)}]) AS feature)"
