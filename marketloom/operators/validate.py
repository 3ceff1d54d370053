"""Checks of bars, partitions and feeds; each gives a table of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import scan
from marketloom.operators.bars import trading_date
from marketloom.schemas import DAY, KEY


def illegal(prefix: str = "") -> F.Column:
    o, h, lo, c = (F.col(f"{prefix}{x}") for x in ("open", "high", "low", "close"))
    return (h < lo) | (h < F.greatest(o, c)) | (lo > F.least(o, c)) | (lo <= 0)


def bar_issues(bars: DataFrame, arrival: str = "seq") -> DataFrame:
    """Rows with illegal prices, repeated times, or times that go back in arrival order."""
    rows = scan.halo(bars, 1, order=(arrival,), width=100_000)
    line = Window.partitionBy(KEY, "block_").orderBy(arrival)
    rows = scan.home(rows.withColumn("before_", F.lag("event_time_ns").over(line)))
    rows = rows.withColumn("n_", F.count("*").over(Window.partitionBy(KEY, "event_time_ns")))
    kinds = F.array_compact(F.array(F.when(illegal(), "illegal_ohlc"), F.when(F.col("n_") > 1, "duplicate_time"), F.when(F.col("before_") > F.col("event_time_ns"), "not_monotonic")))
    return rows.select(KEY, "event_time_ns", arrival, F.explode(kinds).alias("issue"))


def partition_report(trades: DataFrame, required: tuple[str, ...] = ("price", "quantity")) -> DataFrame:
    """Rows, nulls, ranges, repeated ids and shares of sides of each instrument, in one pass."""
    missing = [c for c in required if c not in trades.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    nulls = [F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_nulls") for c in required]
    ranges = [x for c in required for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return trades.groupBy(KEY).agg(
        F.count("*").alias("rows"), *nulls, *ranges, F.sum((F.col("price") <= 0).cast("int")).alias("bad_prices"), (F.count("seq") - F.countDistinct("seq")).alias("duplicate_ids"),
        F.avg((F.col("side") == "BUY").cast("double")).alias("buy_share"),
    )


def daily_coverage(bars: DataFrame, per_day: int) -> DataFrame:
    """Each day between an instrument's first and last: bars, and whether there are too few, too
    many or none."""
    d = bars.groupBy(KEY, trading_date().alias("day")).agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("event_time_ns")).alias("duplicates"))
    ends = d.groupBy(KEY).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(KEY, F.explode(F.sequence("a", "b")).alias("day"))
    n = F.coalesce("rows", F.lit(0))
    status = F.when(n == 0, "missing").when(n < per_day, "under").when(n > per_day, "over").otherwise("ok")
    return days.join(d, [KEY, "day"], "left").select(KEY, "day", n.alias("rows"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), status.alias("status"))


def parity(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-9, floor_ns: int = 10**6) -> DataFrame:
    """Rows of two feeds (keys floored in time) that differ by more than a relative tolerance, or
    that only one has."""
    at = idiv(F.col("event_time_ns"), floor_ns).alias("t")
    x = a.select(KEY, at, "seq", *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    y = b.select(KEY, at, "seq", *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    j = x.join(y, [KEY, "t", "seq"], "full_outer")
    off = F.lit(False)
    for c in columns:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        off |= F.coalesce(F.abs(p - q) > tolerance * F.greatest(F.abs(p), F.abs(q), F.lit(1.0)), p.isNull() != q.isNull())
    kind = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(off, "different")
    return j.withColumn("diff", kind).where("diff is not null").drop("in_a", "in_b")


def latencies(events: DataFrame, receive: str = "receive_time_ns", process: str = "process_time_ns") -> DataFrame:
    """Delays between the three clocks of each event."""
    return events.withColumns({"receive_latency_ns": F.col(receive) - F.col("event_time_ns"), "process_latency_ns": F.col(process) - F.col(receive), "total_latency_ns": F.col(process) - F.col("event_time_ns")})


def latency_stats(events: DataFrame, keys: list[str], points: dict[str, float], receive: str = "receive_latency_ns", process: str = "process_latency_ns", total: str = "total_latency_ns") -> DataFrame:
    """For each key and clock (receive, process, total): count, mean, greatest value and exact
    quantiles by name of the latencies that are known. A clock that a key never has keeps its row."""
    each = F.array(*(F.struct(F.lit(name).alias("clock"), F.col(c).alias("latency")) for name, c in (("receive", receive), ("process", process), ("total", total))))
    rows = events.select(*keys, F.inline(each))
    sums = rows.groupBy(*keys, "clock").agg(F.count("latency").alias("n"), F.avg("latency").alias("mean"), F.max("latency").alias("most"))
    return sums.join(scan.quantiles(rows, [*keys, "clock"], "latency", points), [*keys, "clock"])


def choose_time(semantics: str) -> F.Column:
    """event, receive or process time, falling back to the clock before."""
    order = {"event": ("event_time_ns",), "receive": ("receive_time_ns", "event_time_ns"), "process": ("process_time_ns", "receive_time_ns", "event_time_ns")}[semantics]
    return F.coalesce(*order)


def warmup_split(bars: DataFrame, n: int) -> DataFrame:
    """Flags each instrument's first n rows as warm-up."""
    return scan.numbered(bars).withColumn("is_warmup", F.col("ord_") < n).drop("ord_")


def canonical(bars: DataFrame, arrival: str) -> tuple[DataFrame, DataFrame]:
    """Clean bars (last arrival of each time, legal prices) and the issues found on the way."""
    from marketloom.sources.files import normalize

    return normalize(bars, arrival).where(~illegal()), bar_issues(bars, arrival)


DAY_NS = DAY
