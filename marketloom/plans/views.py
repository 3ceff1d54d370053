"""Views over the driver's tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import bars as B
from marketloom.schemas import HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column) -> F.Column:
    """Nanoseconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())) * 1000


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("I"), (F.col("user_id") % 8).cast("string")).alias("instrument_id"),
        ns("ts").alias("event_time_ns"),
        F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return t.select(
        "instrument_id", "event_time_ns", "seq",
        (F.col("price") - 0.01 * (1 + F.col("seq") % 5)).alias("bid_price"),
        (F.col("price") + 0.01 * (1 + F.col("seq") % 3)).alias("ask_price"),
        (F.col("quantity") + 1 + F.col("seq") % 7).alias("bid_size"),
        (F.col("quantity") + 1 + F.col("seq") % 4).alias("ask_size"),
    )


def bars(spark: SparkSession, sf_dir: str, interval: int = HOUR) -> DataFrame:
    """Hourly bars with order-flow columns; seq is 0, as times are unique per instrument."""
    return B.time_bars(trades(spark, sf_dir), interval, extended=True)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat("l_returnflag", "l_linestatus").alias("run_uid"),
        ns("l_shipdate").alias("event_time_ns"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") * F.col("l_tax")).cast("double").alias("commission"),
    )


def blotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = x.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    entry = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    out = j.select(
        F.concat("l_returnflag", "l_linestatus").alias("run_uid"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        ns("o_orderdate").alias("entry_time_ns"), ns("l_shipdate").alias("exit_time_ns"),
        F.col("l_quantity").cast("double").alias("quantity"), entry.alias("entry_price"),
        (entry * (F.lit(1.0) + F.col("l_tax").cast("double") - F.col("l_discount").cast("double"))).alias("exit_price"),
    )
    return out.withColumn("realized_pnl", F.col("quantity") * (F.col("exit_price") - F.col("entry_price")))


def daily_pnl(spark: SparkSession, sf_dir: str, trades: DataFrame | None = None) -> DataFrame:
    b = blotter(spark, sf_dir) if trades is None else trades
    return b.groupBy("run_uid", idiv(F.col("exit_time_ns"), 86_400 * 10**9).alias("day")).agg(
        F.sum("realized_pnl").alias("pnl"), F.avg("exit_price").alias("close")
    )


def equity(spark: SparkSession, sf_dir: str, trades: DataFrame | None = None) -> DataFrame:
    """A hundred million and the running sum of daily profit per run; of trades, if they are there."""
    from pyspark.sql import Window

    d = daily_pnl(spark, sf_dir, trades)  # one row per run and day
    w = Window.partitionBy("run_uid").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(
        "run_uid", (F.col("day") * 86_400 * 10**9).alias("event_time_ns"),
        (F.lit(1e8) + F.sum("pnl").over(w)).alias("equity"), "close", F.signum("pnl").alias("position"),
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten levels on both sides of each quote."""
    q = quotes(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(10))))
    size = ((F.col("seq") * F.col("level")) % 17 + 1).cast("double")
    step = 0.01 * (F.col("level") - 1)
    side = F.explode(F.array(
        F.struct(F.lit("BID").alias("side"), (F.col("bid_price") - step).alias("price")),
        F.struct(F.lit("ASK").alias("side"), (F.col("ask_price") + step).alias("price")),
    ))
    return q.select(F.col("seq").alias("snapshot_id"), "instrument_id", "level", size.alias("size"), side.alias("s")).select(
        "snapshot_id", "instrument_id", "s.side", "level", "s.price", "size"
    )


TRADES = """v_trades AS (SELECT 'I' || (user_id % 8) AS instrument_id, epoch_us(ts) * 1000 AS event_time_ns, event_id AS seq,
  100.0::DOUBLE + value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity,
  CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM events)"""
QUOTES = """v_quotes AS (SELECT instrument_id, event_time_ns, seq, price - 0.01::DOUBLE * (1 + seq % 5) AS bid_price,
  price + 0.01::DOUBLE * (1 + seq % 3) AS ask_price, quantity + 1 + seq % 7 AS bid_size, quantity + 1 + seq % 4 AS ask_size FROM v_trades)"""
BARS = f"""v_bars AS (SELECT instrument_id, (event_time_ns // {HOUR}) * {HOUR} AS event_time_ns, 0 AS seq,
  arg_min(price, struct_pack(a := event_time_ns, b := seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, struct_pack(a := event_time_ns, b := seq)) AS close, sum(quantity) AS volume, sum(price * quantity) AS quote_volume,
  count(*) AS trade_count, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS taker_buy_volume,
  sum(CASE WHEN side = 'BUY' THEN price * quantity ELSE 0 END) AS taker_buy_quote_volume
  FROM v_trades GROUP BY 1, 2)"""
FILLS = """v_fills AS (SELECT l_returnflag || l_linestatus AS run_uid, epoch_us(l_shipdate) * 1000 AS event_time_ns,
  l_orderkey * 10 + l_linenumber AS seq, CAST(l_extendedprice * l_tax AS DOUBLE) AS commission FROM lineitem)"""
BLOTTER = """v_blotter AS (SELECT *, quantity * (exit_price - entry_price) AS realized_pnl FROM (
  SELECT *, entry_price * (1.0::DOUBLE + l_tax::DOUBLE - l_discount::DOUBLE) AS exit_price FROM (
  SELECT l_returnflag || l_linestatus AS run_uid, l_orderkey * 10 + l_linenumber AS trade_id, epoch_us(o_orderdate) * 1000 AS entry_time_ns,
  epoch_us(l_shipdate) * 1000 AS exit_time_ns, l_quantity::DOUBLE AS quantity, (l_extendedprice / l_quantity)::DOUBLE AS entry_price,
  l_tax, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))"""
DAILY = """v_daily AS (SELECT run_uid, exit_time_ns // 86400000000000 AS day, sum(realized_pnl) AS pnl, avg(exit_price) AS close FROM v_blotter GROUP BY 1, 2)"""
EQUITY = """v_equity AS (SELECT run_uid, day * 86400000000000 AS event_time_ns,
  1e8::DOUBLE + sum(pnl) OVER (PARTITION BY run_uid ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity, close, sign(pnl)::DOUBLE AS position FROM v_daily)"""
DEPTH = """v_depth AS (SELECT seq AS snapshot_id, instrument_id, s.side AS side, level, s.price AS price, ((seq * level) % 17 + 1)::DOUBLE AS size FROM (
  SELECT *, unnest([{'side': 'BID', 'price': bid_price - 0.01::DOUBLE * (level - 1)}, {'side': 'ASK', 'price': ask_price + 0.01::DOUBLE * (level - 1)}]) AS s
  FROM v_quotes, (SELECT unnest(range(1, 11)) AS level)))"""

PARTS = {"v_trades": (TRADES,), "v_quotes": (TRADES, QUOTES), "v_bars": (TRADES, BARS), "v_fills": (FILLS,), "v_blotter": (BLOTTER,), "v_daily": (BLOTTER, DAILY), "v_equity": (BLOTTER, DAILY, EQUITY), "v_depth": (TRADES, QUOTES, DEPTH)}


def sql(*views: str) -> str:
    """The WITH list (without a final comma) that defines the views."""
    return ", ".join(dict.fromkeys(p for v in views for p in PARTS[v]))
