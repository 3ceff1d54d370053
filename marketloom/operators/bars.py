"""Aggregation of ticks, quotes and finer bars into bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import scan
from marketloom.schemas import DAY, HOUR, KEY, ORDER

#: Parts of one unit of volume or value in which `amount_bars` counts.
UNITS = 10**9
PRICE_NAMES, SIZE_NAMES = ("price", "last", "close", "mid"), ("size", "volume", "quantity", "qty")
_first = lambda c: F.min_by(c, F.struct(*ORDER))
_last = lambda c: F.max_by(c, F.struct(*ORDER))


def fallback(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that a row has a value in."""
    found = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def bucket(interval: int, column: str = "event_time_ns") -> Column:
    """Start of the interval that holds the time; integer arithmetic, right for negatives too."""
    return F.col(column) - F.pmod(F.col(column), F.lit(interval))


def trading_date(column: str = "event_time_ns") -> Column:
    """UTC calendar date of a time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), idiv(F.col(column), DAY).cast("int"))


def ohlcv(price: str = "price", size: str = "size") -> list[Column]:
    return [_first(price).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), _last(price).alias("close"), F.sum(size).alias("volume")]


def time_bars(ticks: DataFrame, interval: int, extended: bool = False) -> DataFrame:
    """Bars of equal time spans, labelled by their start.

    A row without size counts as 1, and volume is flagged synthetic for an instrument that has
    no size at all. `extended` adds trade counts, quote volume and taker-buy sums.
    """
    rows = ticks.withColumn("price_", fallback(ticks, PRICE_NAMES)).withColumn("size_", fallback(ticks, SIZE_NAMES)).where("price_ is not null")
    rows = rows.withColumn("n_", F.coalesce("size_", F.lit(1.0))).withColumn("start_", bucket(interval))
    aggs = [*ohlcv("price_", "n_"), F.sum(F.col("price_") * F.col("n_")).alias("quote_volume"), F.count("*").alias("trade_count")]
    aggs.append((F.count("size_") == 0).alias("volume_is_synthetic"))
    if extended and "side" in ticks.columns:
        buy = F.col("side") == "BUY"
        aggs += [F.sum(F.when(buy, F.col("n_")).otherwise(0.0)).alias("taker_buy_volume"), F.sum(F.when(buy, F.col("price_") * F.col("n_")).otherwise(0.0)).alias("taker_buy_quote_volume")]
    out = rows.groupBy(KEY, "start_").agg(*aggs)
    out = out.withColumnRenamed("start_", "event_time_ns").withColumn("seq", F.lit(0).cast("long"))
    return out.withColumn("trading_date", trading_date())


def resample(bars: DataFrame, interval: int) -> DataFrame:
    """Finer bars into coarser ones."""
    rows = bars.withColumn("start_", bucket(interval))
    out = rows.groupBy(KEY, "start_").agg(_first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), _last("close").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("start_", "event_time_ns").withColumn("seq", F.lit(0).cast("long"))


def quote_mid_bars(quotes: DataFrame, interval: int) -> DataFrame:
    """Bars of the mid price; volume counts quotes."""
    mid = quotes.select(KEY, *ORDER, ((F.col("bid_price") + F.col("ask_price")) / 2).alias("mid"))
    return time_bars(mid, interval).select(KEY, *ORDER, "open", "high", "low", "close", "volume")


def calendar_bars(ticks: DataFrame, unit: str, step: int = 1, left_open: bool = True, stamp_close: bool = True, origin: int = 0) -> DataFrame:
    """Bars of calendar spans: unit is millisecond, second, minute, hour, day, week, month or year.

    Left-open spans hold their closing time and not their opening one. `origin` (ns) shifts fixed
    spans. The bar's time is its closing or opening time.
    """
    fixed = {"millisecond": 10**6, "second": 10**9, "minute": 60 * 10**9, "hour": HOUR, "day": DAY, "week": 7 * DAY}
    at = F.col("event_time_ns") - F.lit(1 if left_open else 0)
    if unit in fixed:
        width = fixed[unit] * step
        shift = origin + (4 * DAY if unit == "week" else 0)  # weeks begin on Mondays
        start = at - F.pmod(at - F.lit(shift), F.lit(width))
        end = start + F.lit(width)
    else:
        months = step * (12 if unit == "year" else 1)
        day = F.date_add(F.lit("1970-01-01").cast("date"), idiv(at, DAY).cast("int"))
        index = (F.year(day) - 1970) * 12 + F.month(day) - 1
        first = index - F.pmod(index, F.lit(months))
        ns = lambda m: F.datediff(F.add_months(F.lit("1970-01-01").cast("date"), m), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(DAY)
        start, end = ns(first), ns(first + months)
    rows = ticks.withColumn("price_", fallback(ticks, PRICE_NAMES)).withColumn("n_", F.coalesce(fallback(ticks, SIZE_NAMES), F.lit(1.0)))
    rows = rows.withColumn("start_", start).withColumn("end_", end)
    out = rows.groupBy(KEY, "start_", "end_").agg(*ohlcv("price_", "n_"))
    return out.withColumn("event_time_ns", F.col("end_" if stamp_close else "start_")).withColumnsRenamed({"start_": "start_ns", "end_": "end_ns"}).withColumn("seq", F.lit(0).cast("long"))


def fill_empty(bars: DataFrame, interval: int) -> DataFrame:
    """Bars with one for every span between an instrument's first and last: empty spans repeat
    the last close with no volume. The calendar is made per instrument and day."""
    ends = bars.groupBy(KEY).agg(F.min("event_time_ns").alias("a"), F.max("event_time_ns").alias("b"))
    days = ends.select(KEY, "a", "b", F.explode(F.sequence(idiv(F.col("a"), DAY), idiv(F.col("b"), DAY))).alias("d"))
    spans = days.select(KEY, "a", "b", F.explode(F.sequence(F.col("d") * F.lit(DAY), F.col("d") * F.lit(DAY) + F.lit(DAY - interval), F.lit(interval))).alias("event_time_ns"))
    spans = spans.where("event_time_ns between a and b").select(KEY, "event_time_ns", F.lit(0).cast("long").alias("seq"))
    last = scan.as_of(spans, bars, ["close"], prefix="last_")
    out = last.join(bars.drop("seq"), [KEY, "event_time_ns"], "left")
    fill = lambda c: F.coalesce(c, "last_close").alias(c)
    return out.select(KEY, "event_time_ns", "seq", fill("open"), fill("high"), fill("low"), fill("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("open").isNull().alias("is_empty"))


def tick_bars(ticks: DataFrame, n: int) -> DataFrame:
    """A bar for every n ticks of an instrument, the last one perhaps shorter."""
    rows = scan.numbered(ticks).withColumn("bar", F.floor(F.col("ord_") / n)).withColumn("size", fallback(ticks, SIZE_NAMES))
    return _numbered_bars(rows)


def _numbered_bars(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(KEY, "bar").agg(*ohlcv(), F.count("*").alias("tick_count"), F.max("event_time_ns").alias("event_time_ns"))
    return out.select(KEY, "bar", "event_time_ns", "open", "high", "low", "close", "volume", "tick_count")


def amount_bars(ticks: DataFrame, step: float, notional: bool = False) -> DataFrame:
    """A bar for every `step` units of volume (or of price times size).

    A tick that crosses a boundary is split: each bar gets the part that fills it, and a tick
    larger than a step makes several bars. Amounts are counted in whole billionths, so that running
    sums, which come from block totals, are exact at any length and in any order of summing.
    """
    size = F.coalesce(fallback(ticks, SIZE_NAMES), F.lit(0.0))
    amount = size * F.col("price") if notional else size
    ticks = ticks.withColumn("amount_", amount).where("amount_ > 0 and not isnan(amount_)")
    rows = scan.prefix(ticks.withColumn("amount_", F.round(F.col("amount_") * UNITS).cast("decimal(28,0)")), {"upto_": F.col("amount_")})
    rows = rows.withColumn("from_", F.col("upto_") - F.col("amount_"))
    whole = F.lit(round(step * UNITS)).cast("decimal(19,0)")
    low = F.call_function("div", F.col("from_"), whole)
    rows = rows.withColumn("bar", F.explode(F.sequence(low, F.greatest(low, F.call_function("div", F.col("upto_") - 1, whole)))))
    part = F.least(F.col("upto_"), (F.col("bar") + 1) * whole) - F.greatest(F.col("from_"), F.col("bar") * whole)
    part = part.cast("double") / UNITS
    rows = rows.withColumn("size", (part / F.col("price")) if notional else part)
    return _numbered_bars(rows)


def signed_bars(ticks: DataFrame, step: float, kind: str = "tick", runs: bool = False, **parameters) -> DataFrame:
    """Imbalance bars (a bar closes when the signed sum reaches `step` either way) or run bars
    (when one side's run reaches it; a change of side starts the run afresh).

    kind: tick, volume or value. Ticks of unknown side count with neither. The state decides where
    bars end; as it starts afresh with each bar, blocks of one instrument run side by side from
    guesses that are checked (`scan.speculate`, which gets the parameters). Repeated ticks count
    as often as they come.
    """
    weight = {"tick": F.lit(1.0), "volume": F.col("quantity"), "value": F.col("price") * F.col("quantity")}[kind]
    sign = F.when(F.col("side") == "BUY", 1.0).when(F.col("side") == "SELL", -1.0).otherwise(0.0)

    def run(columns: dict[str, np.ndarray], held: float) -> tuple[float, int, dict[str, np.ndarray]]:
        bar, bars = 0, []
        for x in columns["x_"].tolist():
            if runs and held * x < 0:
                held = 0.0
            held += x
            bars.append(bar)
            if abs(held) >= step:
                bar, held = bar + 1, 0.0
        return held, bar, {"bar_": np.array(bars, np.int64)}

    rows = scan.speculate(ticks.withColumn("x_", F.coalesce(weight, F.lit(0.0)) * sign), run, lambda _: 0.0, ["x_"], "bar_ long", **parameters)
    return _numbered_bars(rows.withColumns({"size": fallback(ticks, SIZE_NAMES), "bar": F.col("before_") + F.col("bar_")}))


def renko(ticks: DataFrame, brick: float, **parameters) -> DataFrame:
    """Bricks of fixed height: a move of k heights from the last brick's close makes k bricks.

    Closes lie on a grid from the instrument's first price, so the state is a whole number, and
    blocks run side by side (`scan.speculate`, which gets the parameters).
    """
    # prices order equal times and numbers, so that a rerun makes the same bricks
    known = ticks.where("price is not null and not isnan(price)").select(KEY, "event_time_ns", "seq", "price")
    base = known.groupBy(KEY).agg(F.min(F.struct("event_time_ns", "seq", "price")).alias("first_"))
    known = scan.numbered(known.join(base, KEY).withColumn("first_", F.col("first_.price")), order=("event_time_ns", "seq", "price"))

    def run(columns: dict[str, np.ndarray], at: float) -> tuple[float, int, dict[str, np.ndarray]]:
        base, begun, made, n = columns["first_"][0] if len(columns["first_"]) else 0.0, [], [], 0
        for p in columns["price"].tolist():
            move = p - (base + at * brick)
            k = int((abs(move) + 1e-9) // brick)
            begun.append(at)
            made.append(k if move > 0 else -k)
            at += made[-1]
            n += k
        made = np.array(made, np.int64)
        return at, n, {"at_": np.array(begun, np.int64), "made_": made, "prior_": np.cumsum(np.abs(made)) - np.abs(made)}

    def guess(columns: dict[str, np.ndarray]) -> float:
        return float(np.trunc((columns["price"][0] - columns["first_"][0]) / brick))

    rows = scan.speculate(known, run, guess, ["price", "first_"], "at_ long, made_ long, prior_ long", **parameters).where("made_ <> 0")
    rows = rows.withColumn("j_", F.explode(F.sequence(F.lit(0), F.abs("made_").cast("int") - 1)))
    way = F.signum("made_").cast("int")
    level = lambda k: F.col("first_") + (F.col("at_") + way * k) * F.lit(brick)
    return rows.select(KEY, (F.col("before_") + F.col("prior_") + F.col("j_")).alias("brick"), "event_time_ns", level(F.col("j_")).alias("open"), level(F.col("j_") + 1).alias("close"), way.alias("direction"))


def adjust(ticks: DataFrame, rolls: DataFrame, ratio: bool = True) -> DataFrame:
    """Prices of a continuous contract: before each roll they are scaled (or shifted) by it.

    rolls: instrument_id, roll_time_ns, factor. Adjustments of all later rolls apply.
    """
    line = Window.partitionBy(KEY).orderBy(F.desc("event_time_ns")).rowsBetween(Window.unboundedPreceding, 0)
    amount = F.log("factor") if ratio else F.col("factor")
    later = rolls.select(KEY, F.col("roll_time_ns").alias("event_time_ns"), F.lit(0).cast("long").alias("seq"), amount.alias("x"))
    later = later.withColumn("total", F.sum("x").over(line)).drop("x")  # a few rows for each instrument
    # a tick at the roll's time is already of the new contract
    shifted = ticks.withColumn("event_time_ns", F.col("event_time_ns") + 1)
    found = scan.as_of(shifted, later, ["total"], forward=True).withColumn("event_time_ns", F.col("event_time_ns") - 1)
    total = F.coalesce("total", F.lit(0.0))
    return found.withColumn("adjusted_price", F.col("price") * F.exp(total) if ratio else F.col("price") + total).drop("total", "asof_time_ns")


def spread_quotes(quotes: DataFrame, legs: list[tuple[str, float]], name: str) -> DataFrame:
    """Quotes of a synthetic spread: at each leg's quote the latest quotes of all legs, times
    their ratios; a negative ratio takes the other side."""
    times = quotes.where(F.col(KEY).isin([leg for leg, _ in legs])).select(F.lit(name).alias("spread"), "event_time_ns", "seq")
    out, bid, ask = times, F.lit(0.0), F.lit(0.0)
    for k, (leg, ratio) in enumerate(legs):
        side = quotes.where(F.col(KEY) == leg).select(F.lit(name).alias("spread"), "event_time_ns", "seq", F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"))
        out = scan.as_of(out, side, ["bid", "ask"], prefix=f"l{k}_", key="spread").drop(f"l{k}_asof_time_ns")
        own, other = (f"l{k}_bid", f"l{k}_ask") if ratio >= 0 else (f"l{k}_ask", f"l{k}_bid")
        bid, ask = bid + F.col(own) * ratio, ask + F.col(other) * ratio
    return out.select(F.col("spread").alias(KEY), "event_time_ns", "seq", bid.alias("bid_price"), ask.alias("ask_price")).where("bid_price is not null and ask_price is not null")
