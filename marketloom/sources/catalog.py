"""Catalogue of stored data: queries, inventories, manifests, plans, and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import scan
from marketloom.operators.bars import trading_date
from marketloom.schemas import DAY, KEY

FILE_KEY = ("feature_set_id", "feature_version", KEY, "trading_date", "path", "checksum")


def query(df: DataFrame, ids: list[str] | None = None, start: int | None = None, end: int | None = None, where: str | None = None, ordered: bool = True) -> DataFrame:
    """Rows of instruments in an inclusive time range, in time order."""
    if ids is not None:
        df = df.where(F.col(KEY).isin(ids))
    if start is not None:
        df = df.where(F.col("event_time_ns") >= start)
    if end is not None:
        df = df.where(F.col("event_time_ns") <= end)
    df = df.where(where) if where else df
    return df.orderBy("event_time_ns", "seq") if ordered else df


def merge_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Typed streams as one, in global time order, range-partitioned."""
    named = [df.withColumn("stream", F.lit(n)) for n, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).orderBy("event_time_ns", "stream", KEY, "seq")


def first_last(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(F.min("event_time_ns").alias("first_ns"), F.max("event_time_ns").alias("last_ns"))


def missing_intervals(stored: DataFrame, start: int, end: int) -> DataFrame:
    """Gaps of [start, end] that no stored interval (instrument_id, start_ns, end_ns) covers."""
    inside = stored.where((F.col("end_ns") >= start) & (F.col("start_ns") <= end)).select(KEY, "start_ns", "end_ns")
    reached = scan.running_max(inside, "end_ns", "reach_", order=("start_ns", "end_ns"))  # in blocks, as histories may be long
    near = scan.halo(reached, 0, 1, order=("start_ns", "end_ns"))
    after = F.lead("start_ns").over(Window.partitionBy(KEY, "block_").orderBy("ord_"))
    gaps = scan.home(near.withColumn("after_", after)).select(KEY, (F.col("reach_") + 1).alias("gap_start"), (F.col("after_") - 1).alias("gap_end")).where("gap_start <= gap_end")
    head = inside.groupBy(KEY).agg(F.lit(start).alias("gap_start"), (F.min("start_ns") - 1).alias("gap_end")).where("gap_start <= gap_end")
    gaps = gaps.unionByName(head)
    tail = inside.groupBy(KEY).agg((F.max("end_ns") + 1).alias("gap_start")).withColumn("gap_end", F.lit(end)).where("gap_start <= gap_end")
    none = stored.select(KEY).distinct().join(inside.select(KEY).distinct(), KEY, "left_anti").select(KEY, F.lit(start).alias("gap_start"), F.lit(end).alias("gap_end"))
    return gaps.unionByName(tail).unionByName(none)


def inventory(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """Files and bytes of each partition, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path", "length")
    parts = [F.regexp_extract("path", rf"/{k}=([^/]+)/", 1).alias(k) for k in keys]
    return files.select(*parts, "length").groupBy(*keys).agg(F.count("*").alias("file_count"), F.sum("length").alias("bytes")).orderBy(*keys)


def instrument_scan(df: DataFrame) -> DataFrame:
    """Rows, first and last time, span and days with data of each instrument."""
    days = idiv(F.max("event_time_ns"), DAY) - idiv(F.min("event_time_ns"), DAY) + 1
    return df.groupBy(KEY).agg(
        F.count("*").alias("rows"), F.min("event_time_ns").alias("first_ns"), F.max("event_time_ns").alias("last_ns"), days.alias("span_days"), F.countDistinct(trading_date()).alias("days_with_data")
    )


def ingest_plan(symbols: DataFrame, start: str, end: str, present: DataFrame, monthly: bool = False) -> DataFrame:
    """Expected partitions (symbol, period) and whether each is there or to be fetched."""
    step, form = ("interval 1 month", "yyyy-MM") if monthly else ("interval 1 day", "yyyy-MM-dd")
    first = F.date_trunc("month", F.lit(start).cast("date")).cast("date") if monthly else F.lit(start).cast("date")
    wanted = symbols.select("symbol", F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr(step))).alias("d")).select("symbol", F.date_format("d", form).alias("period"))
    have = present.select("symbol", "period").distinct().withColumn("there_", F.lit(True))
    return wanted.join(have, ["symbol", "period"], "left").select("symbol", "period", F.when(F.col("there_"), "skip").otherwise("download").alias("action"))


# Manifests


def params_digest(params: dict) -> Column:
    """16 hex digits that name a set of parameters, whatever their order."""
    pairs = (F.concat_ws("=", F.lit(str(k)), F.lit(repr(params[k]))) for k in sorted(params))
    return F.substring(F.sha2(F.concat_ws("\n", *pairs), 256), 1, 16)


def manifest_rows(df: DataFrame, partition: list[str], feature: str, version: int, params: dict, source: str) -> DataFrame:
    """Manifest rows of written partitions: counts, time range and a checksum of keys."""
    key = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in partition))
    return df.groupBy(key.alias("partition_key")).agg(
        F.count("*").alias("row_count"), F.min("event_time_ns").alias("start_ts"), F.max("event_time_ns").alias("end_ts"), F.bit_xor(F.xxhash64(KEY, "event_time_ns")).alias("checksum")
    ).select("partition_key", F.lit(feature).alias("feature_name"), F.lit(version).alias("version"), params_digest(params).alias("params_hash"), "row_count", "start_ts", "end_ts", "checksum", F.lit(source).alias("source"))


def overlapping(manifest: DataFrame, start: int, end: int) -> DataFrame:
    """Files whose time range meets [start, end]."""
    return manifest.where((F.col("start_ts") <= end) & (F.col("end_ts") >= start))


def dedup(manifest: DataFrame, keys: list[str], by: str = "created_at") -> DataFrame:
    """The newest row of each key."""
    return compact(manifest, keys, by)


def compact(manifest: DataFrame, keys: list[str], by: str = "created_at", newest: bool = True) -> DataFrame:
    """One row for each key: the newest (or the oldest), ties by all columns."""
    rest = [c for c in manifest.columns if c not in keys]
    pick = (F.max_by if newest else F.min_by)(F.struct(*rest), F.struct(by, *(c for c in rest if c != by)))
    return manifest.groupBy(*keys).agg(pick.alias("r")).select(*keys, "r.*").select(*manifest.columns)


def summary(manifest: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.groupBy(*keys).agg(F.count("*").alias("file_count"), F.sum("row_count").alias("rows"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def needs_recompute(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Wanted (partition, feature, version, params) that the manifest doesn't hold."""
    return wanted.join(manifest, ["partition_key", "feature_name", "version", "params_hash"], "left_anti")


# Features at rest


def merge_groups(features: DataFrame, columns: list[str], keys=(KEY, "event_time_ns")) -> DataFrame:
    """One row per key from rows of several feature groups: the only (or largest) value of each."""
    return features.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))


def feature_query(events: DataFrame, ids: list[str] | None = None, sets: list[str] | None = None, start: int | None = None, end: int | None = None, warmup: bool = False) -> DataFrame:
    """Feature events by instrument, set and time, sorted; of several for one (time, instrument,
    set) the least row."""
    for c, v in ((KEY, ids), ("feature_set_id", sets)):
        events = events.where(F.col(c).isin(v)) if v is not None else events
    events = events.where(F.col("ts_event") >= start) if start is not None else events
    events = events.where(F.col("ts_event") <= end) if end is not None else events
    events = events if warmup else events.where(~F.col("is_warmup"))
    keys = ["ts_event", KEY, "feature_set_id"]
    rest = [c for c in events.columns if c not in keys]
    one = events.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*keys, "r.*").select(*events.columns).orderBy(*keys)


def available(manifest: DataFrame) -> DataFrame:
    return manifest.select("feature_name").distinct()


def latest(events: DataFrame, time: str = "ts_event") -> DataFrame:
    """The newest event of each instrument and set; of several at one time the greatest row."""
    rest = [time, *(c for c in events.columns if c not in (KEY, "feature_set_id", time))]
    return events.groupBy(KEY, "feature_set_id").agg(F.max(F.struct(*rest)).alias("r")).select(KEY, "feature_set_id", "r.*")


def window(events: DataFrame, k: int, time: str = "ts_event") -> DataFrame:
    """The last k events of each instrument and set; Spark prunes each task's rows to k first."""
    last = Window.partitionBy(KEY, "feature_set_id").orderBy(F.desc(time))
    return events.withColumn("n_", F.row_number().over(last)).where(F.col("n_") <= k).drop("n_")


# Writing


def write_hive(df: DataFrame, path: str, partition: list[str], mode: str = "error", issues: DataFrame | None = None) -> None:
    """Partitioned Parquet. mode: error, append, or overwrite (of the partitions written only).
    With issues given, any row of it refuses the write."""
    if issues is not None and issues.limit(1).count():
        raise ValueError("validation issues: nothing was written")
    out = df.repartition(*partition).write.partitionBy(*partition)
    if mode == "overwrite":
        out = out.option("partitionOverwriteMode", "dynamic")
    out.mode(mode).parquet(path)
