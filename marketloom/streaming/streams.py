"""Structured Streaming: replay, normalisation, bars, de-duplication and stateful features.

The same step functions serve batch and stream. Spark's watermark is one per query, so a fast
instrument could make a slow one late; the stateful processor therefore keeps a watermark of its
own for each instrument, and the query's watermark only clears old state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.functions.ints import idiv
from marketloom.operators.scan import affine_run
from marketloom.schemas import KEY

POLICIES = ("drop", "log_only", "update_if_not_finalized", "recompute_for_backtest_only")


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stored Parquet as a stream, some files for each micro-batch, with `ts` for watermarks."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.timestamp_micros(idiv("event_time_ns", 1000)))


def normalize_json(raw: DataFrame) -> DataFrame:
    """Exchange messages (column json, receive_time_ns) as trades and quotes; others are dropped.

    The trade time comes first, then the event time, then when the message was received. Keys
    differ by case only, so they are read by path.
    """
    get = lambda c: F.get_json_object("json", f"$.{c}")
    num = lambda c: get(c).try_cast("double")
    whole = lambda c: get(c).try_cast("bigint")
    trade = get("e") == "aggTrade"
    kind = F.when(trade, "trade").when(get("b").isNotNull() & get("A").isNotNull(), "quote")
    at = F.coalesce(whole("T") * 10**6, whole("E") * 10**6, F.col("receive_time_ns"))
    return raw.withColumn("kind", kind).where("kind is not null").select(
        "kind", get("s").alias(KEY), at.alias("event_time_ns"), F.coalesce(whole("a"), whole("u")).alias("seq"), F.when(trade, num("p")).alias("price"), F.when(trade, num("q")).alias("quantity"),
        F.when(trade, F.when(get("m") == "true", "SELL").otherwise("BUY")).alias("side"), F.when(F.col("kind") == "quote", num("b")).alias("bid_price"), F.when(F.col("kind") == "quote", num("a")).alias("ask_price"), "receive_time_ns",
    )


def bars(trades: DataFrame, interval: str, lateness: str | None = "10 minutes") -> DataFrame:
    """Tick bars by event-time windows; with a lateness, a window is final once the watermark
    passes its end (append mode)."""
    rows = trades.withWatermark("ts", lateness) if lateness else trades
    at = F.struct("event_time_ns", "seq")
    out = rows.groupBy(KEY, F.window("ts", interval)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume")
    )
    return out.select(KEY, (F.unix_micros("window.start") * 1000).alias("event_time_ns"), "open", "high", "low", "close", "volume")


def dedup(events: DataFrame, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Each key once, with state for as long as the lateness only."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


FEATURES = "instrument_id string, event_time_ns long, seq long, price double, ema double, mean_5 double, is_ready boolean, is_late boolean, n long"
_STATE = "ema double, high_ns long, n long, tail array<double>"
#: Rows that a processor makes at a time.
CHUNK = 8192


def is_used(late: bool, t: int, high: int | None, window_ns: int, policy: str, live: bool) -> bool:
    """Whether an event changes the state: late ones by policy. drop and log_only use none,
    update_if_not_finalized those still inside the window before the latest time, and
    recompute_for_backtest_only all of them, but none in a live run."""
    if not late:
        return True
    if policy == "update_if_not_finalized":
        return t > high - window_ns
    return policy == "recompute_for_backtest_only" and not live


def step(state: tuple | None, t: int, x: float, alpha: float, k: int, lateness_ns: int, policy: str, window_ns: int = 3600 * 10**9, live: bool = False) -> tuple[tuple, tuple | None]:
    """One event: the new state, and what to emit for it.

    state: exponential mean, the latest time seen, events counted, and the last k prices. An event
    is late if it is older than the latest time less the lateness of this instrument alone. A late
    event that isn't used gives no row, or under log_only one with the state as it is.
    """
    if state is None:
        state = (None, None, 0, [])
    ema, high, n, tail = state
    late = high is not None and t < high - lateness_ns
    if not is_used(late, t, high, window_ns, policy, live):
        return state, (ema, None, n >= k, True, n) if policy == "log_only" else None
    ema = x if ema is None else ema + alpha * (x - ema)
    tail = [*tail, x][-k:]
    n += 1
    high = t if high is None else max(high, t)
    return (ema, high, n, tail), (ema, sum(tail) / k if len(tail) == k else None, n >= k, late, n)


class FeatureProcessor(StatefulProcessor):
    """Keeps each instrument's state between micro-batches, in the query's checkpoint."""

    def __init__(self, alpha: float, k: int, lateness_ns: int, policy: str, window_ns: int, live: bool):
        if policy not in POLICIES:
            raise ValueError(f"unknown late policy {policy!r}")
        self.args = alpha, k, lateness_ns, policy, window_ns, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("features", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.value.get() if self.value.exists() else None
        state = None if state is None else (state[0], state[1], state[2], list(state[3]))
        # three arrays of the micro-batch; Python numbers and rows to emit only some thousands at a time
        parts = [tuple(r[c].to_numpy(kind) for c, kind in (("event_time_ns", np.int64), ("seq", np.int64), ("price", float))) for r in rows]
        times, seqs, prices = map(np.concatenate, zip(*parts))
        del parts
        line = np.lexsort((seqs, times))
        for at in range(0, len(line), CHUNK):
            some, out = line[at : at + CHUNK], []
            for t, s, x in zip(times[some].tolist(), seqs[some].tolist(), prices[some].tolist()):
                state, made = step(state, t, x, *self.args)
                if made is not None:
                    out.append((key[0], t, s, x, *made))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])
        self.value.update(state)

    def close(self) -> None:
        pass


def features(trades: DataFrame, alpha: float = 2 / 11, k: int = 5, lateness_ns: int = 60 * 10**9, policy: str = "update_if_not_finalized", window_ns: int = 3600 * 10**9, live: bool = False) -> DataFrame:
    """Per-instrument exponential and rolling means over a stream of trades, with late events by
    policy (`is_used`)."""
    rows = trades.select(KEY, "event_time_ns", "seq", "price")
    return rows.groupBy(KEY).transformWithStateInPandas(FeatureProcessor(alpha, k, lateness_ns, policy, window_ns, live), FEATURES, "append", "none")


STREAM = (KEY, "kind", "source")
MARKS = "instrument_id string, kind string, source string, event_time_ns long, seq long, watermark_ns long, is_late boolean"


class WatermarkProcessor(StatefulProcessor):
    """Keeps the latest time of each stream of events."""

    def __init__(self, lateness_ns: int):
        self.lateness_ns = lateness_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("latest", "high_ns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["event_time_ns", "seq"], kind="stable")
        at = table["event_time_ns"].to_numpy(np.int64)
        before = self.value.get()[0] if self.value.exists() else None
        high = np.maximum.accumulate(at if before is None else np.maximum(at, before))
        earlier = np.concatenate(([at[0] if before is None else before], high[:-1]))
        self.value.update((int(high[-1]),))
        made = {"event_time_ns": at, "seq": table["seq"].to_numpy(np.int64), "watermark_ns": high - self.lateness_ns, "is_late": at < earlier - self.lateness_ns}
        yield pd.DataFrame(dict(zip(STREAM, key)) | made)

    def close(self) -> None:
        pass


def watermarks(events: DataFrame, lateness_ns: int = 60 * 10**9) -> DataFrame:
    """Each event of the streams (instrument, kind, source) with its stream's watermark after it
    and whether it came late. A fast stream doesn't make the events of a slow one late."""
    rows = events.select(*STREAM, "event_time_ns", "seq")
    return rows.groupBy(*STREAM).transformWithStateInPandas(WatermarkProcessor(lateness_ns), MARKS, "append", "none")


CONTAINERS = "instrument_id string, event_time_ns long, seq long, ema double, mean_k double, std_k double, span_sum double, span_vwap double, n long"
_SUMMED = "ema double, n long, tail array<double>, done_ns long, done_seq long, high_ns long"
_BUCKET = "times array<bigint>, seqs array<bigint>, prices array<double>, sizes array<double>"
#: Buckets that a span is kept in.
BUCKETS = 8


class ContainerProcessor(StatefulProcessor):
    """Keeps, for each instrument, an exponential mean, the last k prices, and the prices and sizes
    of a time span; Spark saves them with the query's checkpoint and restores them from it.

    Events are kept in a map by time bucket: a micro-batch writes the buckets that its events fall
    into, and removes those that no span reaches any more. Events come out in order once they are
    `lateness_ns` older than the instrument's newest, so those that come out of order by that much
    stand where they belong. Later ones, and those seen before, change nothing.
    """

    def __init__(self, alpha: float, k: int, span_ns: int, lateness_ns: int):
        self.alpha, self.k, self.span_ns, self.lateness_ns = alpha, k, span_ns, lateness_ns
        self.width = max(1, span_ns // BUCKETS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", _SUMMED)
        self.events = handle.getMapState("events", "bucket long", _BUCKET)

    def _keep(self, times: np.ndarray, seqs: np.ndarray, prices: np.ndarray, sizes: np.ndarray) -> None:
        """Put events into their buckets, each (time, seq) once, in order."""
        bucket = times // self.width
        for key in np.unique(bucket).tolist():
            own = bucket == key
            parts = [x[own] for x in (times, seqs, prices, sizes)]
            if self.events.containsKey((key,)):
                parts = [np.concatenate((np.array(list(held), x.dtype), x)) for held, x in zip(self.events.getValue((key,)), parts)]
            order = np.lexsort((parts[1], parts[0]))
            parts = [x[order] for x in parts]
            new = np.append(True, (np.diff(parts[0]) != 0) | (np.diff(parts[1]) != 0))
            self.events.updateValue((key,), tuple(x[new].tolist() for x in parts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ema, n, tail, done, done_seq, high = self.sums.get() if self.sums.exists() else (None, 0, [], None, None, None)
        table = pd.concat(list(rows))
        times, seqs = (table[c].to_numpy(np.int64) for c in ("event_time_ns", "seq"))
        prices, sizes = (table[c].to_numpy(float) for c in ("price", "quantity"))
        high = int(times.max()) if high is None else max(high, int(times.max()))
        use = ~np.isnan(prices)
        if done is not None:
            use &= (times > done) | ((times == done) & (seqs > done_seq))
        if use.any():
            self._keep(times[use], seqs[use], prices[use], np.nan_to_num(sizes[use]))
        edge = high - self.lateness_ns
        held = sorted(k[0] for k in self.events.keys())
        near = [self.events.getValue((k,)) for k in held if k * self.width <= edge and (done is None or (k + 1) * self.width > done - self.span_ns)]
        at, seq, price, size = (np.concatenate([np.array(list(x[c]), kind) for x in near]) if near else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, float, float)))
        whole = at <= edge
        at, seq, price, size = at[whole], seq[whole], price[whole], size[whole]
        new = np.ones(len(at), bool) if done is None else (at > done) | ((at == done) & (seq > done_seq))
        if new.any():
            first, last = np.searchsorted(at, at[new] - self.span_ns, side="right"), np.searchsorted(at, at[new], side="right")
            total = lambda x: (s := np.concatenate(([0.0], np.cumsum(x))))[last] - s[first]
            span_sum, volume, money = total(price), total(size), total(price * size)
            run = price[new]
            frames = pd.Series(np.concatenate((np.array(list(tail), float), run))).rolling(self.k)
            keep, gain = np.full(len(run), 1 - self.alpha), self.alpha * run
            if ema is None:
                keep[0], gain[0] = 0.0, run[0]
            means = affine_run(keep, gain, ema or 0.0)
            yield pd.DataFrame({
                KEY: key[0], "event_time_ns": at[new], "seq": seq[new], "ema": means, "mean_k": frames.mean().to_numpy()[-len(run) :], "std_k": frames.std().to_numpy()[-len(run) :], "span_sum": span_sum,
                "span_vwap": np.divide(money, volume, out=np.full(len(run), np.nan), where=volume > 0), "n": np.arange(n + 1, n + len(run) + 1),
            })
            ema, n, done, done_seq = float(means[-1]), n + len(run), int(at[-1]), int(seq[-1])
            tail = [*tail, *run.tolist()][-(self.k - 1) :] if self.k > 1 else []
        self.sums.update((ema, n, list(tail), done, done_seq, high))
        for k in held:
            if done is not None and (k + 1) * self.width <= done - self.span_ns:
                self.events.removeKey((k,))

    def close(self) -> None:
        pass


def containers(trades: DataFrame, alpha: float = 2 / 11, k: int = 5, span_ns: int = 3600 * 10**9, lateness_ns: int = 0) -> DataFrame:
    """Exponential mean, mean and sample deviation of the last k prices, and the sum of prices and
    the volume-weighted price over (t - span, t], after each trade of a stream.

    Trades may come out of order by `lateness_ns`; each comes out once nothing before it can come.
    A trade without price is a heartbeat: it only says how far an instrument's time has come. Of
    trades at one time each span holds all that came out together.
    """
    rows = trades.select(KEY, "event_time_ns", "seq", "price", "quantity")
    return rows.groupBy(KEY).transformWithStateInPandas(ContainerProcessor(alpha, k, span_ns, lateness_ns), CONTAINERS, "append", "none")


def run_to_snapshot(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregation over all that is there; each micro-batch replaces the whole result at
    path, which executors write."""

    def replace(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there, into Parquet with exactly-once commits."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
