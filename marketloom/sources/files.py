"""Files in: bars, trades, klines, ticks and fixed-point quotes; rows that cannot be read apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.bars import fallback
from marketloom.schemas import KEY

#: Names under which foreign files hold what we need, the likeliest first.
TIME_NAMES = ("event_time_ns", "ts_event", "timestamp", "time", "datetime", "date", "open_time", "ts", "ts_init")
SYMBOL_NAMES = ("instrument_id", "symbol", "ticker", "code", "contract")
ALIASES = {"open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c", "last"), "volume": ("volume", "vol", "v", "qty")}
KLINE = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double, ignore string"
AGG_TRADE = "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, time long, is_buyer_maker boolean"


def to_ns(column: Column, unit: str) -> Column:
    """Times in s, ms, us or ns as nanoseconds, in integers only."""
    factor = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}[unit]
    return column.cast("long") * F.lit(factor)


def auto_ns(column: Column) -> Column:
    """Milliseconds or microseconds, told apart row by row by their size."""
    x = column.cast("long")
    return F.when(x > 10**13, x * 1000).otherwise(x * 10**6)


def first_of(columns: list[str], names: tuple[str, ...]) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[n] for n in names if n in lower), None)


def infer(columns: list[str]) -> dict[str, str | None]:
    """What a foreign file's columns are, and whether it holds bars, trades or quotes."""
    found: dict[str, str | None] = {"time": first_of(columns, TIME_NAMES), "symbol": first_of(columns, SYMBOL_NAMES)}
    found |= {k: first_of(columns, n) for k, n in ALIASES.items()}
    lower = {c.lower() for c in columns}
    if all(found[k] for k in ("open", "high", "low", "close")):
        kind = "bar"
    elif {"bid_price", "ask_price"} <= lower or {"bid", "ask"} <= lower:
        kind = "quote"
    else:
        kind = "trade" if lower & {"price", "last"} else None
    return found | {"kind": kind}


def timeframe(path: Column) -> Column:
    """Bar size in a path, such as 15m, 1h or 1d, or null. Random ids in names of files are no sizes."""
    named = F.regexp_replace(path, "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}", "")
    return F.nullif(F.regexp_extract(named, r"(?:^|[/_.\-])(\d+(?:ms|s|m|h|d|w))(?:[/_.\-]|$)", 1), F.lit(""))


def time_ns(df: DataFrame) -> Column:
    """The table's time as nanoseconds, whatever column and type hold it."""
    name = first_of(df.columns, TIME_NAMES)
    if name is None:
        raise ValueError(f"no time column among {df.columns}")
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()) if kind == "timestamp_ntz" else F.col(name)) * 1000
    if kind == "string":
        return F.unix_micros(F.to_timestamp(name)) * 1000
    return F.col(name).cast("long") if name.endswith("_ns") or name.startswith("ts_") else auto_ns(F.col(name))


def read_bars(spark: SparkSession, root: str, filters: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Partitioned bars: equality filters and inclusive dates prune folders before any read.

    Missing open, high and low take the close, a missing volume is 0.
    """
    df = spark.read.parquet(root)
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == v)
    day = first_of(df.columns, ("trading_date", "date"))
    if day and start:
        df = df.where(F.col(day) >= F.lit(start).cast(dict(df.dtypes)[day]))
    if day and end:
        df = df.where(F.col(day) <= F.lit(end).cast(dict(df.dtypes)[day]))
    symbol = first_of(df.columns, SYMBOL_NAMES)
    get = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    close = F.col("close")
    return df.select(
        F.col(symbol).cast("string").alias(KEY), time_ns(df).alias("event_time_ns"), get("seq", F.lit(0)).cast("long").alias("seq"),
        *(get(c, close).cast("double").alias(c) for c in ("open", "high", "low")), close.cast("double").alias("close"), get("volume", F.lit(0.0)).cast("double").alias("volume"),
    )


def side_of(df: DataFrame) -> Column:
    """A trade's side: given, or SELL if the buyer was the maker."""
    maker = F.when(F.col("is_buyer_maker"), "SELL").when(~F.col("is_buyer_maker"), "BUY") if "is_buyer_maker" in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.upper("side"), maker) if "side" in df.columns else maker


def read_trades(spark: SparkSession, root: str, filters: dict[str, str] | None = None) -> DataFrame:
    df = spark.read.parquet(root)
    missing = {"price", "quantity"} - set(df.columns)
    if missing:
        raise ValueError(f"trades lack {sorted(missing)}")
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == v)
    quote = F.coalesce(F.col("quote_quantity"), F.col("price") * F.col("quantity")) if "quote_quantity" in df.columns else F.col("price") * F.col("quantity")
    seq = first_of(df.columns, ("seq", "trade_id"))
    return df.select(
        F.col(first_of(df.columns, SYMBOL_NAMES)).cast("string").alias(KEY), time_ns(df).alias("event_time_ns"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"),
        F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"), quote.cast("double").alias("quote_quantity"), side_of(df).alias("side"),
    )


def read_csv_bars(spark: SparkSession, path: str, mapping: dict[str, str], unit: str = "ms") -> tuple[DataFrame, DataFrame]:
    """Bars of CSV files with a column mapping, and the rows that don't hold numbers."""
    raw = spark.read.option("header", True).csv(path)
    num = lambda c: F.expr(f"try_cast(`{mapping[c]}` AS double)")
    out = raw.select(
        F.col(mapping[KEY]).alias(KEY), to_ns(F.expr(f"try_cast(`{mapping['time']}` AS bigint)"), unit).alias("event_time_ns"), F.lit(0).cast("long").alias("seq"),
        *(num(c).alias(c) for c in ("open", "high", "low", "close", "volume")), F.struct(*raw.columns).alias("raw"),
    )
    bad = F.col("event_time_ns").isNull() | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull()
    return out.where(~bad).drop("raw"), out.where(bad).select(KEY, "raw")


def symbol_of(path: Column) -> Column:
    """The symbol in an archive's name, such as I1-1h-2024-01.csv (or in a folder of that name)."""
    return F.regexp_extract(path, r"(?:^|[/=])([A-Z0-9]+)-(?:\d+[mhdw]|aggTrades)(?=[-./])", 1)


def read_klines(spark: SparkSession, path: str, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kline archives (no header) of one symbol, or of all symbols by their names: bars, and rows
    whose high is below their low."""
    raw = spark.read.option("recursiveFileLookup", True).schema(KLINE).csv(path).where("open_time is not null")
    name = F.lit(symbol) if symbol else symbol_of(F.col("_metadata.file_path"))
    bars = raw.select(name.alias(KEY), auto_ns(F.col("open_time")).alias("event_time_ns"), F.lit(0).cast("long").alias("seq"), *(c for c in raw.columns if c not in ("open_time", "close_time", "ignore")))
    return bars.where("high >= low"), bars.where("high < low")


def read_agg_trades(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Aggregated-trade archives (no header) of one symbol, or of all by their names, as trades."""
    raw = spark.read.option("recursiveFileLookup", True).schema(AGG_TRADE).csv(path).where("time is not null")
    name = F.lit(symbol) if symbol else symbol_of(F.col("_metadata.file_path"))
    return raw.select(
        name.alias(KEY), auto_ns(F.col("time")).alias("event_time_ns"), F.col("agg_trade_id").alias("seq"), "price", "quantity",
        (F.col("price") * F.col("quantity")).alias("quote_quantity"), F.when(F.col("is_buyer_maker"), "SELL").otherwise("BUY").alias("side"), "is_buyer_maker",
    )


def inventory(df: DataFrame) -> DataFrame:
    """What is found in each file of a table: its folder's name, rows, kind of data and first and
    last time by the inferred columns, and the bar size in its path."""
    found = infer(df.columns)
    at = time_ns(df) if found["time"] else F.lit(None).cast("long")
    rows = df.select(F.col("_metadata.file_path").alias("file"), at.alias("t"))
    out = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("t").alias("first_ns"), F.max("t").alias("last_ns"))
    return out.withColumns({"kind": F.lit(found["kind"]), "timeframe": timeframe(F.col("file"))})


def generic(df: DataFrame, symbol: str = "UNKNOWN") -> DataFrame:
    """A foreign bar or tick table in our layout, by inferred columns."""
    found = infer(df.columns)
    key = F.col(found["symbol"]).cast("string") if found["symbol"] else F.lit(symbol)
    base = df.select(key.alias(KEY), time_ns(df).alias("event_time_ns"), F.lit(0).cast("long").alias("seq"), "*")
    if found["kind"] == "bar":
        return base.select(KEY, "event_time_ns", "seq", *(F.col(found[c]).cast("double").alias(c) for c in ("open", "high", "low", "close")), (F.col(found["volume"]) if found["volume"] else F.lit(0.0)).cast("double").alias("volume"))
    if found["kind"] == "trade":
        return base.select(KEY, "event_time_ns", "seq", fallback(df, ("price", "last")).alias("price"), fallback(df, ("quantity", "size", "qty", "volume")).alias("quantity"))
    raise ValueError(f"neither bars nor trades: {df.columns}")


def decode_fixed(df: DataFrame, columns: list[str], scale: int) -> DataFrame:
    """Binary fixed-point columns (little-endian, 8 or 16 bytes) as doubles, in Arrow batches."""
    kinds = {f.name: ("double" if f.name in columns else f.dataType.simpleString()) for f in df.schema}

    def value(raw: bytes | None) -> float | None:
        return None if raw is None else int.from_bytes(raw, "little", signed=True) / 10**scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for name in b.schema.names:
                c = b.column(name)
                if name not in columns:
                    made.append(c)
                    continue
                raw = c.to_pylist()
                if raw and all(x is not None and len(x) == 8 for x in raw):
                    made.append(pa.array(np.frombuffer(b"".join(raw), "<i8") / 10**scale))
                else:
                    made.append(pa.array([value(x) for x in raw], pa.float64()))
            yield pa.RecordBatch.from_arrays(made, b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def normalize(bars: DataFrame, arrival: str) -> DataFrame:
    """One row for each instrument and time: the one that arrived last."""
    last = Window.partitionBy(KEY, "event_time_ns").orderBy(F.desc(arrival), F.xxhash64(*bars.columns))
    return bars.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_")


def instruments(dumps: DataFrame) -> DataFrame:
    """Instrument dimension from JSON market dumps (column json), one row each."""
    kind = "symbol string, type string, precision struct<price:double, amount:double>, limits struct<amount:struct<min:double, max:double>>, active boolean"
    m = dumps.select(F.from_json("json", kind).alias("m")).where("m.symbol is not null")
    return m.select(
        F.col("m.symbol").alias(KEY), F.col("m.type").alias("market_type"), F.col("m.precision.price").alias("tick_size"), F.col("m.precision.amount").alias("lot_size"),
        F.col("m.limits.amount.min").alias("min_quantity"), F.col("m.limits.amount.max").alias("max_quantity"), F.coalesce("m.active", F.lit(True)).alias("active"),
    ).dropDuplicates([KEY])
