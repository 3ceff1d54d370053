"""Queries of sources, sinks, the catalogue and validation with their oracles.

Round trips write what Spark derives from the tables to the shared folder, and read it back.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.functions.features import REGISTRY
from marketloom.operators import scan, stats
from marketloom.operators import validate as C
from marketloom.operators.bars import trading_date
from marketloom.plans import views as V
from marketloom.plans.q_features import EXPR, KEYS, LINE, NUDGE
from marketloom.schemas import DAY, HOUR
from marketloom.sources import catalog as A
from marketloom.sources import dataset as D
from marketloom.sources import files as S
from marketloom.sources import store as K

QUERIES, ORACLES = {}, {}
rnd = lambda c: F.round(F.col(c).cast("double") + NUDGE, 6).alias(c)
rs = lambda e, c=None: f"round({e} + {NUDGE}, 6) AS {c or e}"
OHLCV = ("open", "high", "low", "close", "volume")
BASE, TR = f"WITH {V.sql('v_bars')}", f"WITH {V.sql('v_trades')}"
_bars_sql = f"SELECT instrument_id, event_time_ns, seq, {', '.join(rs(c) for c in OHLCV)} FROM v_bars"


def place(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        scan.settled(spark.range(1))
        folder = spark.conf.get("spark.checkpoint.dir")
    return f"{folder.rstrip('/')}/marketloom-files-{uuid.uuid4().hex}"


def shown(df):
    return df.select(*KEYS, *map(rnd, OHLCV))


def _parquet_bars(s, d):
    path = place(s)
    A.write_hive(V.bars(s, d).withColumn("trading_date", F.col("trading_date").cast("string")), path, ["trading_date"])
    return shown(S.read_bars(s, path, {"instrument_id": "I3"}, "2024-01-05", "2024-01-12"))


QUERIES["src_parquet_bars"] = _parquet_bars
ORACLES["src_parquet_bars"] = f"{BASE} {_bars_sql} WHERE instrument_id = 'I3' AND CAST(make_timestamp(event_time_ns // 1000) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"


def _parquet_trades(s, d):
    path = place(s)
    t = V.trades(s, d).withColumn("is_buyer_maker", F.col("side") == "SELL").drop("side").withColumn("trading_date", trading_date().cast("string"))
    A.write_hive(t, path, ["trading_date"])
    return S.read_trades(s, path).select(*KEYS, rnd("price"), rnd("quantity"), rnd("quote_quantity"), "side")


QUERIES["src_parquet_trades"] = _parquet_trades
ORACLES["src_parquet_trades"] = f"{TR} SELECT instrument_id, event_time_ns, seq, {rs('price')}, {rs('quantity')}, {rs('price * quantity', 'quote_quantity')}, side FROM v_trades"


def _csv(s, d, bad: bool):
    path = place(s)
    b = V.bars(s, d)
    text = b.select("instrument_id", idiv("event_time_ns", 10**6).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.when(idiv("event_time_ns", HOUR) % 10 == 3, "n/a").otherwise(F.col("close").cast("string")).alias("c"), F.col("volume").alias("v"))
    text.write.option("header", True).csv(path)
    names = {"instrument_id": "instrument_id", "time": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    return S.read_csv_bars(s, path, names)[bad]


QUERIES["src_csv_bars"] = lambda s, d: shown(_csv(s, d, False))
ORACLES["src_csv_bars"] = f"{BASE} {_bars_sql} WHERE event_time_ns // {HOUR} % 10 <> 3"
QUERIES["src_csv_quarantine"] = lambda s, d: _csv(s, d, True).groupBy("instrument_id").agg(F.count("*").alias("n"))
ORACLES["src_csv_quarantine"] = f"{BASE} SELECT instrument_id, count(*) AS n FROM v_bars WHERE event_time_ns // {HOUR} % 10 = 3 GROUP BY 1"


def _archives(df, key, path, kind):
    """One folder for each symbol, named like an exchange's archives."""
    named = df.withColumn("archive", F.concat(F.col(key), F.lit(f"-{kind}-2024-01.csv"))).drop(key)
    named.repartition("archive").write.partitionBy("archive").csv(path)


def _klines(s, d):
    path = place(s)
    b = V.bars(s, d)
    hour = idiv("event_time_ns", HOUR)
    at = F.when(hour % 2 == 0, idiv("event_time_ns", 10**6)).otherwise(idiv("event_time_ns", 1000))  # milliseconds and microseconds mixed
    rows = b.select("instrument_id", at.alias("t"), "open", "high", "low", "close", "volume", idiv("event_time_ns", 10**6).alias("e"), "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume", F.lit("0").alias("i"))
    _archives(rows, "instrument_id", path, "1h")
    return shown(S.read_klines(s, path)[0])


QUERIES["src_exchange_klines"] = _klines
ORACLES["src_exchange_klines"] = f"{BASE} {_bars_sql}"


def _agg(s, d):
    path = place(s)
    rows = V.trades(s, d).select("instrument_id", "seq", "price", "quantity", F.col("seq").alias("a"), F.col("seq").alias("b"), idiv("event_time_ns", 1000).alias("t"), (F.col("side") == "SELL").alias("m"))
    _archives(rows, "instrument_id", path, "aggTrades")
    return S.read_agg_trades(s, path).select(*KEYS, rnd("price"), rnd("quantity"), rnd("quote_quantity"), "side")


QUERIES["src_exchange_aggtrades"] = _agg
ORACLES["src_exchange_aggtrades"] = f"{TR} SELECT instrument_id, event_time_ns, seq, {rs('price')}, {rs('quantity')}, {rs('price * quantity', 'quote_quantity')}, side FROM v_trades"
QUERIES["src_generic_ticks"] = lambda s, d: S.generic(V.trades(s, d).select(F.col("instrument_id").alias("ticker"), F.col("event_time_ns").alias("ts_event"), F.col("price").alias("last"), F.col("quantity").alias("qty"))).select("instrument_id", "event_time_ns", rnd("price"), rnd("quantity"))
ORACLES["src_generic_ticks"] = f"{TR} SELECT instrument_id, event_time_ns, {rs('price')}, {rs('quantity')} FROM v_trades"


def _fixed(s, d):
    q = V.quotes(s, d)
    little = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.round(F.col(c) * 10**4).cast("long")), 16, "0"), 15 - 2 * k, 2) for k in range(8))))
    return S.decode_fixed(q.select(*KEYS, little("bid_price").alias("bid_price"), little("ask_price").alias("ask_price")), ["bid_price", "ask_price"], 4).select(*KEYS, rnd("bid_price"), rnd("ask_price"))


QUERIES["src_fixed_point_quotes"] = _fixed
ORACLES["src_fixed_point_quotes"] = f"WITH {V.sql('v_quotes')} SELECT instrument_id, event_time_ns, seq, {rs('bid_price')}, {rs('ask_price')} FROM v_quotes"


def _infer(s, d):
    """What kind of data files hold, by their columns, rows and paths: bars of two sizes, trades
    and quotes under foreign names, and tables without a time."""
    path = place(s)
    made = {
        "bars-1h": V.bars(s, d).select(F.col("instrument_id").alias("ticker"), F.col("event_time_ns").alias("ts_event"), *OHLCV),
        "bars-1d": V.bars(s, d, DAY).select(F.col("instrument_id").alias("ticker"), F.col("event_time_ns").alias("ts_event"), *OHLCV),
        "ticks": V.trades(s, d).select(F.col("instrument_id").alias("symbol"), F.col("event_time_ns").alias("ts_event"), "price", "quantity"),
        "quotes": V.quotes(s, d).select("instrument_id", "event_time_ns", "bid_price", "ask_price"),
        "orders": V.table(s, d, "orders").select("o_orderkey", "o_totalprice"),
    }
    found = []
    for name, df in made.items():
        df.write.parquet(f"{path}/{name}/data")
        files = S.inventory(s.read.parquet(f"{path}/{name}/data"))
        found.append(files.groupBy("kind", "timeframe").agg(F.sum("rows").alias("rows"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")).withColumn("name", F.lit(name)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("name", "kind", "timeframe", "rows", "first_ns", "last_ns")


QUERIES["src_schema_infer"] = _infer
ORACLES["src_schema_infer"] = f"""{BASE}, v_day AS (SELECT DISTINCT instrument_id, event_time_ns // {DAY} * {DAY} AS t FROM v_trades)
  SELECT 'bars-1h' AS name, 'bar' AS kind, '1h' AS timeframe, count(*) AS rows, min(event_time_ns) AS first_ns, max(event_time_ns) AS last_ns FROM v_bars
  UNION ALL SELECT 'bars-1d', 'bar', '1d', count(*), min(t), max(t) FROM v_day
  UNION ALL SELECT 'ticks', 'trade', NULL, count(*), min(event_time_ns), max(event_time_ns) FROM v_trades
  UNION ALL SELECT 'quotes', 'quote', NULL, count(*), min(event_time_ns), max(event_time_ns) FROM v_trades
  UNION ALL SELECT 'orders', NULL, NULL, count(*), NULL, NULL FROM orders"""


def _twice(s, d):
    b = V.bars(s, d).withColumn("arrival", F.lit(0))
    again = b.where(idiv("event_time_ns", HOUR) % 5 == 0).withColumns({"close": F.col("high"), "arrival": F.lit(1)})
    return b.unionByName(again)


QUERIES["normalize_bars"] = lambda s, d: shown(S.normalize(_twice(s, d), "arrival"))
ORACLES["normalize_bars"] = f"{BASE} SELECT instrument_id, event_time_ns, seq, {', '.join(rs('CASE WHEN event_time_ns // ' + str(HOUR) + ' % 5 = 0 THEN high ELSE close END' if c == 'close' else c, c) for c in OHLCV)} FROM v_bars"


def _instr(s, d):
    p = V.table(s, d, "part")
    dump = p.select(F.to_json(F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_type").alias("type"), F.struct((F.col("p_size") / 100).alias("price"), F.lit(0.1).alias("amount")).alias("precision"), F.struct(F.struct(F.lit(1.0).alias("min"), F.col("p_retailprice").alias("max")).alias("amount")).alias("limits"))).alias("json"), "p_partkey")
    return S.instruments(dump.select("json")).groupBy("market_type").agg(F.count("*").alias("n"), F.round(F.max("tick_size"), 4).alias("tick_size"))


QUERIES["instr_dimension"] = _instr
ORACLES["instr_dimension"] = "SELECT p_type AS market_type, count(*) AS n, round(max(p_size / 100), 4) AS tick_size FROM part GROUP BY 1"
_A, _B = 1704500000 * 10**9, 1705500000 * 10**9
QUERIES["catalog_query"] = lambda s, d: A.query(V.trades(s, d), ["I0", "I5"], _A, _B, "price > 120").select(*KEYS, rnd("price"))
ORACLES["catalog_query"] = f"{TR} SELECT instrument_id, event_time_ns, seq, {rs('price')} FROM v_trades WHERE instrument_id IN ('I0', 'I5') AND event_time_ns BETWEEN {_A} AND {_B} AND price > 120"
QUERIES["catalog_merge_streams"] = lambda s, d: A.merge_streams({"trade": V.trades(s, d).select(*KEYS, "price"), "quote": V.quotes(s, d).select(*KEYS, "bid_price")}).select("stream", *KEYS, rnd("price"), rnd("bid_price"))
ORACLES["catalog_merge_streams"] = f"WITH {V.sql('v_quotes')} SELECT 'trade' AS stream, instrument_id, event_time_ns, seq, {rs('price')}, NULL::DOUBLE AS bid_price FROM v_trades UNION ALL SELECT 'quote', instrument_id, event_time_ns, seq, NULL, round(bid_price + {NUDGE}, 6) FROM v_quotes"
QUERIES["catalog_first_last_ts"] = lambda s, d: A.first_last(V.trades(s, d))
ORACLES["catalog_first_last_ts"] = f"{TR} SELECT instrument_id, min(event_time_ns) AS first_ns, max(event_time_ns) AS last_ns FROM v_trades GROUP BY 1"


def _gaps(s, d):
    b = V.bars(s, d)
    return A.missing_intervals(b.select("instrument_id", F.col("event_time_ns").alias("start_ns"), (F.col("event_time_ns") + HOUR - 1).alias("end_ns")), 1704067200 * 10**9, 1706659200 * 10**9)


QUERIES["catalog_missing_intervals"] = _gaps
_g0, _g1 = 1704067200 * 10**9, 1706659200 * 10**9
ORACLES["catalog_missing_intervals"] = f"""{BASE}, x AS (SELECT instrument_id, event_time_ns AS a, coalesce(lag(event_time_ns) OVER ({LINE}) + {HOUR}, {_g0}) AS p FROM v_bars WHERE event_time_ns BETWEEN {_g0} AND {_g1})
  SELECT instrument_id, p AS gap_start, a - 1 AS gap_end FROM x WHERE p < a UNION ALL SELECT instrument_id, max(a) + {HOUR}, {_g1} FROM x GROUP BY 1 HAVING max(a) + {HOUR} <= {_g1}"""


def _inventory(s, d):
    path = place(s)
    A.write_hive(V.bars(s, d), path, ["trading_date", "instrument_id"])
    return A.inventory(s, path, ["trading_date", "instrument_id"]).select("trading_date", "instrument_id", "file_count", (F.col("bytes") > 0).alias("has_bytes"))


QUERIES["catalog_inventory"] = _inventory
ORACLES["catalog_inventory"] = f"{BASE} SELECT DISTINCT strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS trading_date, instrument_id, 1 AS file_count, true AS has_bytes FROM v_bars"
QUERIES["catalog_instrument_scan"] = lambda s, d: A.instrument_scan(V.trades(s, d))
ORACLES["catalog_instrument_scan"] = f"{TR} SELECT instrument_id, count(*) AS rows, min(event_time_ns) AS first_ns, max(event_time_ns) AS last_ns, max(event_time_ns) // {DAY} - min(event_time_ns) // {DAY} + 1 AS span_days, count(DISTINCT event_time_ns // {DAY}) AS days_with_data FROM v_trades GROUP BY 1"


def _plan(s, d):
    t = V.trades(s, d)
    have = t.where("quantity > 60").select(F.col("instrument_id").alias("symbol"), trading_date().cast("string").alias("period"))
    return A.ingest_plan(t.select(F.col("instrument_id").alias("symbol")).distinct(), "2024-01-01", "2024-02-05", have)


QUERIES["ingest_plan"] = _plan
ORACLES["ingest_plan"] = f"""{TR}, c AS (SELECT DISTINCT instrument_id AS symbol FROM v_trades), w AS (SELECT symbol, strftime(x, '%Y-%m-%d') AS period FROM c, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS x)),
  h AS (SELECT DISTINCT instrument_id AS symbol, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS period FROM v_trades WHERE quantity > 60)
  SELECT w.symbol, w.period, CASE WHEN h.symbol IS NULL THEN 'download' ELSE 'skip' END AS action FROM w LEFT JOIN h ON h.symbol = w.symbol AND h.period = w.period"""


def _manifest(s, d, key=("trading_date",)):
    return A.manifest_rows(V.bars(s, d), list(key), "bars", 1, {"interval": "1h"}, "events")


QUERIES["manifest_append"] = lambda s, d: _manifest(s, d).select("partition_key", "feature_name", "version", "row_count", "start_ts", "end_ts", "source")
_mani = "SELECT 'trading_date=' || strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS partition_key, 'bars' AS feature_name, 1 AS version, count(*) AS row_count, min(event_time_ns) AS start_ts, max(event_time_ns) AS end_ts, 'events' AS source FROM v_bars GROUP BY 1"
ORACLES["manifest_append"] = f"{BASE} {_mani}"
QUERIES["manifest_find_files"] = lambda s, d: A.overlapping(_manifest(s, d), _A, _B).select("partition_key", "row_count")
ORACLES["manifest_find_files"] = f"{BASE}, m AS ({_mani}) SELECT partition_key, row_count FROM m WHERE start_ts <= {_B} AND end_ts >= {_A}"


def _versions(s, d):
    """Three generations of manifest rows for each day and instrument."""
    m = V.bars(s, d).groupBy("instrument_id", trading_date().cast("string").alias("day")).agg(F.count("*").alias("row_count"), F.min("event_time_ns").alias("start_ts"), F.max("event_time_ns").alias("end_ts"))
    return m.withColumn("created_at", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("row_count", F.col("row_count") + F.col("created_at"))


_ver = "ve AS (SELECT instrument_id, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS day, count(*) AS n, min(event_time_ns) AS start_ts, max(event_time_ns) AS end_ts FROM v_bars GROUP BY 1, 2)"
QUERIES["manifest_dedup"] = lambda s, d: A.dedup(_versions(s, d), ["instrument_id", "day"]).select("instrument_id", "day", "row_count", "created_at")
ORACLES["manifest_dedup"] = f"{BASE}, {_ver} SELECT instrument_id, day, n + 3 AS row_count, 3 AS created_at FROM ve"
QUERIES["manifest_compact"] = lambda s, d: A.compact(_versions(s, d), ["instrument_id", "day"], newest=False).select("instrument_id", "day", "row_count", "created_at")
ORACLES["manifest_compact"] = f"{BASE}, {_ver} SELECT instrument_id, day, n + 1 AS row_count, 1 AS created_at FROM ve"
QUERIES["manifest_summary"] = lambda s, d: A.summary(_versions(s, d), ["instrument_id"])
ORACLES["manifest_summary"] = f"{BASE}, {_ver} SELECT instrument_id, count(*) * 3 AS file_count, sum(n * 3 + 6)::BIGINT AS rows, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM ve GROUP BY 1"


def _recompute(s, d):
    m = _manifest(s, d)
    return A.needs_recompute(m.select("partition_key", "feature_name", "version", "params_hash"), m.where("row_count % 2 = 0")).select("partition_key")


QUERIES["manifest_needs_recompute"] = _recompute
ORACLES["manifest_needs_recompute"] = f"{BASE}, m AS ({_mani}) SELECT partition_key FROM m WHERE row_count % 2 <> 0"


def _sink(s, d):
    path = place(s)
    b = V.bars(s, d)
    A.write_hive(b, path, ["trading_date"])
    A.write_hive(b.where("trading_date = date'2024-01-10'").withColumn("close", F.lit(1.0)), path, ["trading_date"], "overwrite")
    return shown(s.read.parquet(path))


QUERIES["sink_hive"] = _sink
ORACLES["sink_hive"] = f"{BASE} SELECT instrument_id, event_time_ns, seq, {', '.join(rs('CASE WHEN event_time_ns // ' + str(DAY) + ' = 19732 THEN 1.0::DOUBLE ELSE close END' if c == 'close' else c, c) for c in OHLCV)} FROM v_bars"


def _archive(s, d):
    """Bars archived as a stream of two micro-batches; counts come from the manifests of files."""
    b, source, root = V.bars(s, d), place(s), place(s)
    for half in (F.col("event_time_ns") < _A, F.col("event_time_ns") >= _A):
        b.where(half).coalesce(1).write.mode("append").parquet(source)
    groups = {"raw": ["open", "close"], "trend": ["feat_sma_20"], "range": ["rolling_range"]}
    stream = s.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(source)
    K.archive_stream(stream, root, groups, ["trading_date"], place(s), lambda rows: REGISTRY.compute(rows, ["feat_sma_20", "rolling_range"]))
    files = s.read.parquet(f"{root}/manifest")
    day = F.concat(F.lit("trading_date="), F.regexp_extract("path", "trading_date=([^/]+)/", 1))
    return files.groupBy(day.alias("partition_key"), F.col("group").alias("feature_name")).agg(F.sum("row_count").alias("row_count"))


QUERIES["sink_eod_archive"] = _archive
ORACLES["sink_eod_archive"] = f"{BASE}, m AS ({_mani}) SELECT partition_key, f AS feature_name, row_count FROM m, (VALUES ('raw'), ('trend'), ('range')) t(f)"


def _compact(s, d):
    path, out = place(s), place(s)
    V.bars(s, d).repartition(12).write.parquet(path)
    K.compact(s, path, out)
    return s.read.parquet(out).withColumn("file", F.input_file_name()).groupBy("instrument_id").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


QUERIES["compact_partition"] = _compact
ORACLES["compact_partition"] = f"{BASE} SELECT instrument_id, count(*) AS n, 1 AS files FROM v_bars GROUP BY 1"


def _scan(s, d):
    """Two feature groups at rest, read for a time range from the files that their manifest names."""
    f = REGISTRY.compute(V.bars(s, d), ["feat_sma_20", "rolling_range"])
    groups, root = {"trend": ["feat_sma_20"], "range": ["rolling_range"]}, place(s)
    manifest = K.write_groups(f, root, groups, ["trading_date"])
    parts = [K.read_range(s, f"{root}/{g}", manifest.where(F.col("group") == g), _A, _B) for g in groups]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return A.merge_groups(both, ["feat_sma_20", "rolling_range"]).select("instrument_id", "event_time_ns", rnd("feat_sma_20"), rnd("rolling_range"))


QUERIES["feature_scan"] = _scan
ORACLES["feature_scan"] = f"{BASE}, f AS (SELECT *, {EXPR['feat_sma_20']} AS x FROM v_bars) SELECT instrument_id, event_time_ns, {rs('x', 'feat_sma_20')}, {rs('high - low', 'rolling_range')} FROM f WHERE event_time_ns BETWEEN {_A} AND {_B}"


def _events(s, d):
    """Two feature sets of bars on different grids, with 5 warm-up rows each, some rows twice."""
    b = scan.numbered(V.bars(s, d))
    one = b.select(idiv("event_time_ns", 10**6).alias("ts_event"), "instrument_id", F.lit("px").alias("feature_set_id"), (F.col("ord_") < 5).alias("is_warmup"), F.col("close").alias("value"))
    two = b.where(idiv("event_time_ns", HOUR) % 4 == 0).select(idiv("event_time_ns", 10**6).alias("ts_event"), "instrument_id", F.lit("vol").alias("feature_set_id"), (F.col("ord_") < 5).alias("is_warmup"), F.col("volume").alias("value"))
    e = one.unionByName(two)
    return e.unionByName(e.where("ts_event % 7200000 = 0"))


_ev = f"nb AS (SELECT *, row_number() OVER ({LINE}) - 1 AS o FROM v_bars), ev AS (SELECT event_time_ns // 1000000 AS ts_event, instrument_id, 'px' AS feature_set_id, o < 5 AS is_warmup, close AS value FROM nb UNION ALL SELECT event_time_ns // 1000000, instrument_id, 'vol', o < 5, volume FROM nb WHERE event_time_ns // {HOUR} % 4 = 0)"
QUERIES["feature_store_query"] = lambda s, d: A.feature_query(_events(s, d), ["I1", "I4"], None, _A // 10**6, _B // 10**6).select("ts_event", "instrument_id", "feature_set_id", rnd("value"))
ORACLES["feature_store_query"] = f"{BASE}, {_ev} SELECT ts_event, instrument_id, feature_set_id, {rs('value')} FROM ev WHERE instrument_id IN ('I1', 'I4') AND ts_event BETWEEN {_A // 10**6} AND {_B // 10**6} AND NOT is_warmup"
QUERIES["feature_available"] = lambda s, d: A.available(_events(s, d).withColumnRenamed("feature_set_id", "feature_name"))
ORACLES["feature_available"] = f"{BASE}, {_ev} SELECT DISTINCT feature_set_id AS feature_name FROM ev"
QUERIES["feature_latest"] = lambda s, d: A.latest(_events(s, d)).select("instrument_id", "feature_set_id", "ts_event", rnd("value"))
ORACLES["feature_latest"] = f"{BASE}, {_ev} SELECT instrument_id, feature_set_id, max(ts_event) AS ts_event, {rs('arg_max(value, ts_event)', 'value')} FROM ev GROUP BY 1, 2"
QUERIES["feature_window"] = lambda s, d: A.window(_events(s, d).distinct(), 5).select("instrument_id", "feature_set_id", "ts_event", rnd("value"))
ORACLES["feature_window"] = f"{BASE}, {_ev} SELECT instrument_id, feature_set_id, ts_event, {rs('value')} FROM ev QUALIFY row_number() OVER (PARTITION BY instrument_id, feature_set_id ORDER BY ts_event DESC) <= 5"
def _label_rows(s, d):
    """A label every 6 hours."""
    b = V.bars(s, d).where(idiv("event_time_ns", HOUR) % 6 == 0)
    return b.select(idiv("event_time_ns", 10**6).alias("ts_event"), "instrument_id", F.col("open").alias("label"))


_SETS = ["vol", "px"]
QUERIES["dataset_load"] = lambda s, d: D.load(_events(s, d), _SETS, ["I1", "I4"], None, _B // 10**6, True).select("ts_event", "instrument_id", "feature_set_id", "is_warmup", rnd("value"))
ORACLES["dataset_load"] = f"{BASE}, {_ev} SELECT ts_event, instrument_id, feature_set_id, is_warmup, {rs('value')} FROM ev WHERE instrument_id IN ('I1', 'I4') AND ts_event <= {_B // 10**6}"
QUERIES["dataset_load_exact"] = lambda s, d: D.load(_events(s, d), ["px", "vol"], join="exact").select("ts_event", "instrument_id", rnd("px__value"), rnd("vol__value"))
ORACLES["dataset_load_exact"] = f"{BASE}, {_ev} SELECT a.ts_event, a.instrument_id, {rs('a.value', 'px__value')}, {rs('b.value', 'vol__value')} FROM ev a JOIN ev b USING (instrument_id, ts_event) WHERE a.feature_set_id = 'px' AND b.feature_set_id = 'vol' AND NOT a.is_warmup AND NOT b.is_warmup"
QUERIES["dataset_load_asof"] = lambda s, d: D.load(_events(s, d), ["px", "vol", "none"], join="asof", labels=_label_rows(s, d)).select("ts_event", "instrument_id", rnd("px__value"), rnd("vol__value"), rnd("label"))
_later = "SELECT event_time_ns // 1000000 AS ts_event, instrument_id, open AS label FROM v_bars WHERE event_time_ns // 3600000000000 % 6 = 0"
_loaded = f"a AS (SELECT * FROM ev WHERE feature_set_id = 'px' AND NOT is_warmup), b AS (SELECT * FROM ev WHERE feature_set_id = 'vol' AND NOT is_warmup), l AS ({_later}), ld AS (SELECT a.ts_event, a.instrument_id, a.value AS x, b.value AS y, l.label FROM a ASOF LEFT JOIN b ON a.instrument_id = b.instrument_id AND a.ts_event >= b.ts_event ASOF LEFT JOIN l ON a.instrument_id = l.instrument_id AND a.ts_event <= l.ts_event)"
ORACLES["dataset_load_asof"] = f"{BASE}, {_ev}, {_loaded} SELECT ts_event, instrument_id, {rs('x', 'px__value')}, {rs('y', 'vol__value')}, {rs('label')} FROM ld"
QUERIES["dataset_load_metadata"] = lambda s, d: D.describe(D.load(_events(s, d), ["px", "vol", "none"], join="asof"), ["px", "vol", "none"]).select(F.array_join("used_feature_sets", ",").alias("used"), "row_count", "start", "end")
ORACLES["dataset_load_metadata"] = f"{BASE}, {_ev} SELECT 'px,vol' AS used, count(*) AS row_count, min(ts_event) AS start, max(ts_event) AS end FROM ev WHERE feature_set_id = 'px' AND NOT is_warmup"


def _vector(s, d):
    e = A.latest(_events(s, d))
    return e.groupBy("instrument_id").pivot("feature_set_id", ["px", "vol"]).agg(F.first("value")).select("instrument_id", rnd("px"), rnd("vol"))


QUERIES["batch_inference_vector"] = _vector
ORACLES["batch_inference_vector"] = f"{BASE}, {_ev} SELECT instrument_id, {rs(chr(39).join(['arg_max(value, ts_event) FILTER (feature_set_id = ', 'px', ')']), 'px')}, {rs(chr(39).join(['arg_max(value, ts_event) FILTER (feature_set_id = ', 'vol', ')']), 'vol')} FROM ev GROUP BY 1"


def _backfill(s, d):
    f = REGISTRY.compute(V.bars(s, d), ["feat_sma_20", "feat_vol_30"])
    path = place(s)
    A.write_hive(f.select(*KEYS, "feat_sma_20", "feat_vol_30", "trading_date"), path, ["trading_date"])
    return s.read.parquet(path).select(*KEYS, rnd("feat_sma_20"), rnd("feat_vol_30"))


QUERIES["feat_backfill"] = _backfill
ORACLES["feat_backfill"] = f"{BASE}, a AS (SELECT *, {EXPR['log_return']} AS log_return FROM v_bars), b AS (SELECT *, {EXPR['feat_vol_30']} AS v, {EXPR['feat_sma_20']} AS m FROM a) SELECT instrument_id, event_time_ns, seq, {rs('m', 'feat_sma_20')}, {rs('v', 'feat_vol_30')} FROM b"

# Validation
QUERIES["quote_derive"] = lambda s, d: V.quotes(s, d).select(*KEYS, F.round((F.col("bid_price") + F.col("ask_price")) / 2 + NUDGE, 6).alias("mid"), F.round(F.col("ask_price") - F.col("bid_price") + NUDGE, 6).alias("spread"))
ORACLES["quote_derive"] = f"WITH {V.sql('v_quotes')} SELECT instrument_id, event_time_ns, seq, {rs('(bid_price + ask_price) / 2', 'mid')}, {rs('ask_price - bid_price', 'spread')} FROM v_quotes"
QUERIES["time_unit_convert"] = lambda s, d: V.trades(s, d).select("seq", S.to_ns(idiv("event_time_ns", 10**9), "s").alias("from_s"), S.auto_ns(idiv("event_time_ns", 10**6)).alias("from_ms"), S.auto_ns(idiv("event_time_ns", 10**3)).alias("from_us"))
ORACLES["time_unit_convert"] = f"{TR} SELECT seq, event_time_ns // 1000000000 * 1000000000 AS from_s, event_time_ns // 1000000 * 1000000 AS from_ms, event_time_ns // 1000 * 1000 AS from_us FROM v_trades"


def _clocks(s, d):
    t = V.trades(s, d)
    return t.withColumns({"receive_time_ns": F.when(F.col("seq") % 5 != 0, F.col("event_time_ns") + (F.col("seq") % 90 + 1) * 10**6), "process_time_ns": F.when(F.col("seq") % 3 != 0, F.col("event_time_ns") + (F.col("seq") % 70 + 95) * 10**6)})


_cl = "cl AS (SELECT *, CASE WHEN seq % 5 <> 0 THEN event_time_ns + (seq % 90 + 1) * 1000000 END AS rt, CASE WHEN seq % 3 <> 0 THEN event_time_ns + (seq % 70 + 95) * 1000000 END AS pt FROM v_trades)"
QUERIES["time_semantics"] = lambda s, d: C.latencies(_clocks(s, d)).select("seq", C.choose_time("receive").alias("receive"), C.choose_time("process").alias("process"), "receive_latency_ns", "process_latency_ns", "total_latency_ns")
ORACLES["time_semantics"] = f"{TR}, {_cl} SELECT seq, coalesce(rt, event_time_ns) AS receive, coalesce(pt, rt, event_time_ns) AS process, rt - event_time_ns AS receive_latency_ns, pt - rt AS process_latency_ns, pt - event_time_ns AS total_latency_ns FROM cl"
_LATE = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
QUERIES["latency_stats"] = lambda s, d: C.latency_stats(C.latencies(_clocks(s, d)), ["instrument_id"], _LATE).select("instrument_id", "clock", "n", *(F.round(c, 3).alias(c) for c in ("mean", *_LATE)), "most")
ORACLES["latency_stats"] = f"{TR}, {_cl}, x AS (SELECT instrument_id, 'receive' AS clock, rt - event_time_ns AS v FROM cl UNION ALL SELECT instrument_id, 'process', pt - rt FROM cl UNION ALL SELECT instrument_id, 'total', pt - event_time_ns FROM cl) SELECT instrument_id, clock, count(v) AS n, round(avg(v), 3) AS mean, {', '.join(f'round(quantile_cont(v::DOUBLE, {q}), 3) AS {c}' for c, q in _LATE.items())}, max(v) AS most FROM x GROUP BY 1, 2"
QUERIES["trading_date"] = lambda s, d: V.trades(s, d).select("seq", trading_date().cast("string").alias("trading_date"))
ORACLES["trading_date"] = f"{TR} SELECT seq, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS trading_date FROM v_trades"
QUERIES["warmup_live_split"] = lambda s, d: C.warmup_split(V.bars(s, d), 50).select(*KEYS, "is_warmup")
ORACLES["warmup_live_split"] = f"{BASE} SELECT instrument_id, event_time_ns, seq, row_number() OVER ({LINE}) <= 50 AS is_warmup FROM v_bars"


def _faulty(s, d):
    """Bars in an arrival order with some prices, times and orders broken."""
    b = V.bars(s, d)
    n = idiv("event_time_ns", HOUR)
    b = b.withColumn("low", F.when(n % 97 == 0, F.col("high") + 1).otherwise(F.col("low"))).withColumn("seq", n * 10 + F.when(n % 53 == 0, 25).otherwise(0))
    return b.unionByName(b.where(n % 41 == 0).withColumn("seq", F.col("seq") + 1))


_fa = f"""fa AS (SELECT instrument_id, event_time_ns, open, high, close, CASE WHEN event_time_ns // {HOUR} % 97 = 0 THEN high + 1 ELSE low END AS low, event_time_ns // {HOUR} * 10 + CASE WHEN event_time_ns // {HOUR} % 53 = 0 THEN 25 ELSE 0 END AS seq FROM v_bars),
  fb AS (SELECT * FROM fa UNION ALL SELECT instrument_id, event_time_ns, open, high, close, low, seq + 1 FROM fa WHERE event_time_ns // {HOUR} % 41 = 0),
  fc AS (SELECT *, lag(event_time_ns) OVER (PARTITION BY instrument_id ORDER BY seq) AS b, count(*) OVER (PARTITION BY instrument_id, event_time_ns) AS n FROM fb)"""
QUERIES["validate_bars"] = lambda s, d: C.bar_issues(_faulty(s, d)).select("instrument_id", "event_time_ns", "seq", "issue")
ORACLES["validate_bars"] = f"{BASE}, {_fa} SELECT instrument_id, event_time_ns, seq, 'illegal_ohlc' AS issue FROM fc WHERE high < low OR high < greatest(open, close) OR low > least(open, close) OR low <= 0 UNION ALL SELECT instrument_id, event_time_ns, seq, 'duplicate_time' FROM fc WHERE n > 1 UNION ALL SELECT instrument_id, event_time_ns, seq, 'not_monotonic' FROM fc WHERE b > event_time_ns"


def _canonical(s, d):
    """Clean bars, and beside them each issue of the rows that came in."""
    clean, issues = C.canonical(_faulty(s, d), "seq")
    clean = clean.select(*KEYS, *map(rnd, OHLCV[:4]), F.lit(None).cast("string").alias("issue"))
    return clean.unionByName(issues, allowMissingColumns=True)


QUERIES["ingest_canonicalize"] = _canonical
_clean = ", ".join(rs(c) for c in OHLCV[:4])
_bad = "high < low OR high < greatest(open, close) OR low > least(open, close) OR low <= 0"
ORACLES["ingest_canonicalize"] = f"""{BASE}, {_fa}, la AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time_ns ORDER BY seq DESC) = 1),
  iss AS (SELECT instrument_id, event_time_ns, seq, 'illegal_ohlc' AS issue FROM fc WHERE {_bad} UNION ALL SELECT instrument_id, event_time_ns, seq, 'duplicate_time' FROM fc WHERE n > 1 UNION ALL SELECT instrument_id, event_time_ns, seq, 'not_monotonic' FROM fc WHERE b > event_time_ns)
  SELECT instrument_id, event_time_ns, seq, {_clean}, NULL AS issue FROM la WHERE NOT ({_bad}) UNION ALL SELECT instrument_id, event_time_ns, seq, NULL, NULL, NULL, NULL, issue FROM iss"""
QUERIES["validate_partition"] = lambda s, d: C.partition_report(V.trades(s, d)).select("instrument_id", "rows", "price_nulls", "quantity_nulls", rnd("price_min"), rnd("price_max"), "bad_prices", "duplicate_ids", rnd("buy_share"))
ORACLES["validate_partition"] = f"{TR} SELECT instrument_id, count(*) AS rows, count(*) - count(price) AS price_nulls, count(*) - count(quantity) AS quantity_nulls, {rs('min(price)', 'price_min')}, {rs('max(price)', 'price_max')}, count(*) FILTER (price <= 0) AS bad_prices, count(seq) - count(DISTINCT seq) AS duplicate_ids, {rs(chr(39).join(['avg((side = ', 'BUY', ')::INT)']), 'buy_share')} FROM v_trades GROUP BY 1"
QUERIES["bar_integrity_stats"] = lambda s, d: C.daily_coverage(V.bars(s, d).where("not (instrument_id = 'I2' and trading_date = date'2024-01-09')"), 24).select("instrument_id", F.col("day").cast("string").alias("day"), "rows", "duplicates", "status")
ORACLES["bar_integrity_stats"] = f"""{BASE}, k AS (SELECT instrument_id, event_time_ns // {DAY} AS dd FROM v_bars WHERE NOT (instrument_id = 'I2' AND event_time_ns // {DAY} = 19731)), e AS (SELECT instrument_id, min(dd) AS a, max(dd) AS b FROM k GROUP BY 1),
  c AS (SELECT instrument_id, unnest(range(a, b + 1)) AS dd FROM e), j AS (SELECT c.instrument_id, c.dd, count(k.dd) AS n FROM c LEFT JOIN k ON k.instrument_id = c.instrument_id AND k.dd = c.dd GROUP BY 1, 2)
  SELECT instrument_id, strftime(make_timestamp(dd * 86400000000), '%Y-%m-%d') AS day, n AS rows, 0 AS duplicates, CASE WHEN n = 0 THEN 'missing' WHEN n < 24 THEN 'under' WHEN n > 24 THEN 'over' ELSE 'ok' END AS status FROM j"""


def _parity(s, d):
    t = V.trades(s, d).select(*KEYS, "price")
    other = t.where("seq % 50 <> 7").withColumn("price", F.when(F.col("seq") % 31 == 0, F.col("price") + 0.5).otherwise(F.col("price")))
    return C.parity(t, other, ["price"]).select("instrument_id", "seq", "diff")


QUERIES["parity_compare"] = _parity
ORACLES["parity_compare"] = f"{TR} SELECT instrument_id, seq, CASE WHEN seq % 50 = 7 THEN 'only_a' ELSE 'different' END AS diff FROM v_trades WHERE seq % 50 = 7 OR seq % 31 = 0"


def _udf(s, d):
    """A user's feature, registered and computed like the others."""
    if "user_range_share" not in REGISTRY.known:
        REGISTRY.add("user_range_share", lambda w: F.col("rolling_range") / F.nullif(w.full(10, F.avg("rolling_range"), "rolling_range"), F.lit(0.0)), ("rolling_range",), 9)
    return REGISTRY.compute(V.bars(s, d), ["user_range_share"]).select(*KEYS, rnd("user_range_share"))


QUERIES["udf_register_feature"] = _udf
_w10 = f"OVER ({LINE} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
ORACLES["udf_register_feature"] = f"{BASE}, x AS (SELECT *, high - low AS rr FROM v_bars) SELECT instrument_id, event_time_ns, seq, round(rr / nullif(CASE WHEN count(rr) {_w10} >= 10 THEN avg(rr) {_w10} END, 0) + {NUDGE}, 6) AS user_range_share FROM x"


def _rolling_median(columns):
    x = columns["close"]
    out = np.full(len(x), np.nan)
    if len(x) >= 15:
        out[14:] = np.median(np.lib.stride_tricks.sliding_window_view(x, 15), axis=1)
    return out


def _udf_grouped(s, d):
    """A user's function of arrays with a lookback, and a feature that builds on it."""
    if "user_median_15" not in REGISTRY.known:
        REGISTRY.add_grouped("user_median_15", _rolling_median, 14, ("close",), group="user")
        REGISTRY.add("user_median_gap", lambda w: F.col("close") - w.lag("user_median_15", 2), ("user_median_15",), 2, group="user")
    return REGISTRY.compute(V.bars(s, d), ["user_median_15", "user_median_gap"]).select(*KEYS, rnd("user_median_15"), rnd("user_median_gap"))


QUERIES["udf_register_grouped"] = _udf_grouped
_w15 = f"OVER ({LINE} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"
ORACLES["udf_register_grouped"] = f"{BASE}, x AS (SELECT *, CASE WHEN count(*) {_w15} >= 15 THEN median(close) {_w15} END AS m FROM v_bars) SELECT instrument_id, event_time_ns, seq, {rs('m', 'user_median_15')}, {rs(f'close - lag(m, 2) OVER ({LINE})', 'user_median_gap')} FROM x"


def _geometric(columns):
    x = columns["price"]
    return {"logs": float(np.log(x).sum()), "n": len(x), "least": float(x.min())}


QUERIES["udf_register_statistic"] = lambda s, d: stats.user_statistic(V.trades(s, d), ["instrument_id"], "share", _geometric, {"logs": "sum", "n": "sum", "least": "min"}, F.round(F.exp(F.col("logs") / F.col("n")) / F.col("least") + NUDGE, 6), ["price"])
ORACLES["udf_register_statistic"] = f"{TR} SELECT instrument_id, round(exp(avg(ln(price))) / min(price) + {NUDGE}, 6) AS share FROM v_trades GROUP BY 1"
