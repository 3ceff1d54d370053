"""Trading signals over bars, intents and position sizes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.features import REGISTRY
from marketloom.operators import indicators, scan
from marketloom.schemas import KEY, ORDER


def crosses(df: DataFrame, value: str, level: float = 0.0) -> DataFrame:
    """Flags of crossing a level upwards and downwards against the row before."""
    rows = scan.halo(df, 1)
    before = F.lag(value).over(Window.partitionBy(KEY, "block_").orderBy(*ORDER))
    over = F.coalesce((before <= level) & (F.col(value) > level), F.lit(False))
    under = F.coalesce((before >= level) & (F.col(value) < level), F.lit(False))
    return scan.home(rows.withColumns({"cross_over": over, "cross_under": under}))


def ma_crossover(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """BUY when the fast mean rises above the slow one, SELL when it falls below, else HOLD."""
    rows = scan.halo(bars, slow)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    mean = lambda n: F.when(F.count("close").over(line.rowsBetween(1 - n, 0)) >= n, F.avg("close").over(line.rowsBetween(1 - n, 0)))
    rows = rows.withColumns({"fast": mean(fast), "slow": mean(slow)})
    pf, ps = F.lag("fast").over(line), F.lag("slow").over(line)
    signal = F.when((pf <= ps) & (F.col("fast") > F.col("slow")), "BUY").when((pf >= ps) & (F.col("fast") < F.col("slow")), "SELL").otherwise("HOLD")
    return scan.home(rows.withColumn("signal", signal))


def trend_breakout(bars: DataFrame, breakout: int = 20, trend: int = 50, atr: int = 14, min_atr_pct: float = 0.001, stop: float = 2.0, giveback: float = 3.0, cooldown: int = 3, allow_short: bool = True) -> DataFrame:
    """Breakouts of the earlier range with trend and volatility filters, stops and a pause.

    Windows give the range, the trend and ATR; only position, entry, best price and pause are the
    fold's state, so it reads six columns and an instrument is one task.
    """
    rows = REGISTRY.layered(scan.halo(bars, max(breakout, trend, atr) + 1), ["true_range"], "block_")
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)

    def full(agg, c, a, b):
        w = line.rowsBetween(a, b)
        return F.when(F.count(c).over(w) >= b - a + 1, agg(c).over(w))

    rows = rows.withColumns({
        "upper_": full(F.max, "high", -breakout, -1), "lower_": full(F.min, "low", -breakout, -1),
        "trend_": full(F.avg, "close", 1 - trend, 0), "atr_": full(F.avg, "true_range", 1 - atr, 0),
    })
    rows = scan.home(rows)

    def exit_reason(side, close, entry, best, beyond, mean, width):
        """Why a position ends; `side` turns a short's comparisons round."""
        name = "long" if side > 0 else "short"
        tests = (("stop", side * (entry - close) >= stop * width), ("giveback", side * (best - close) >= giveback * width), ("trend", side * (mean - close) > 0), ("breakout", side * (beyond - close) > 0))
        return next((f"{name}_exit_{k}" for k, hit in tests if hit), None)

    def step(history: Iterator[tuple], key: str) -> Iterator[tuple]:
        side, entry, best, pause = 0, 0.0, 0.0, 0
        for t, s, close, upper, lower, mean, width in history:
            signal, reason = "HOLD", "warmup_hold"
            if None not in (upper, lower, mean, width):
                lively = close > 0 and width / close >= min_atr_pct
                if side:
                    best = max(best, close) if side > 0 else min(best, close)
                    found = exit_reason(side, close, entry, best, lower if side > 0 else upper, mean, width)
                    reason = found or ("hold_long" if side > 0 else "hold_short")
                    if found:
                        signal, side, pause = ("SELL" if side > 0 else "BUY"), 0, cooldown
                elif pause > 0:
                    pause, reason = pause - 1, "cooldown_hold"
                else:
                    up, down = close > upper, close < lower
                    go = 1 if up and close > mean else -1 if down and close < mean and allow_short else 0
                    if up and down:
                        reason = "ambiguous_hold"
                    elif go and lively:
                        side, entry, best = go, close, close
                        signal, reason = ("BUY", "long_breakout") if go > 0 else ("SELL", "short_breakout")
                    else:
                        reason = "no_signal" if lively else "low_volatility_hold"
            yield key, t, s, signal, reason

    return scan.fold(rows, step, ["event_time_ns", "seq", "close", "upper_", "lower_", "trend_", "atr_"], f"{KEY} string, event_time_ns long, seq long, signal string, reason string")


def vwm_short(bars: DataFrame, setup: int = 5, atr_share: float = 0.5, warmup: int = 20) -> DataFrame:
    """Short entries after volume-weighted momentum turns down, and exits after it turns up.

    The setup's price and age come from windows (rows since the last setup); the position is the
    fold's only state.
    """
    rows = scan.settled(scan.numbered(indicators.vwm_setup(bars)))
    # last setup so far, by blocks: its number and close as one comparable value
    last = F.when(F.col("bear_setup"), F.struct(F.col("ord_").alias("o"), F.col("close").alias("c")))
    rows = scan.running_max(rows.withColumn("mark_", last), "mark_", "seen_").drop("mark_")
    rows = scan.halo(rows, 1)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    rows = rows.withColumns({"before_": F.lag("seen_").over(line), "bull_": F.coalesce(F.lag("bull_setup").over(line), F.lit(False))})
    rows = rows.withColumn("age_", F.when(F.col("before_").isNotNull(), F.col("ord_") - 1 - F.col("before_.o")).otherwise(F.col("ord_")))
    ready = (F.col("ord_") + 1 > warmup) & F.col("momentum").isNotNull() & F.col("prev_atr").isNotNull() & F.col("before_").isNotNull()
    trigger = F.when(ready, F.col("before_.c") - atr_share * F.col("prev_atr"))
    rows = scan.home(rows.withColumns({"trigger_": trigger, "open_": F.coalesce((F.col("volume") > 0) & (F.col("age_") <= setup) & ~F.col("bear_setup"), F.lit(False))}))

    def step(history: Iterator[tuple], key: str) -> Iterator[tuple]:
        short, age = False, 0
        for t, s, low, volume, trigger, is_open, bull in history:
            age = age + 1 if short else age
            enter = trigger is not None and not short and is_open and low <= trigger
            leave = short and age > 0 and volume > 0 and bull
            yield key, t, s, trigger if is_open and not short else None, "enter_short" if enter and not leave else "exit_short" if leave else None
            if enter:
                short, age = True, 0
            elif leave:
                short, age = False, 0

    return scan.fold(rows, step, ["event_time_ns", "seq", "low", "volume", "trigger_", "open_", "bull_"], f"{KEY} string, event_time_ns long, seq long, entry_price double, reason string")


def to_intent(signals: DataFrame, sell_means: str = "flat", quantity: float = 1.0) -> DataFrame:
    """Orders or position targets of signals; HOLD gives none."""
    if sell_means not in ("flat", "short"):
        raise ValueError("sell_means is 'flat' or 'short'")
    rows = signals.where(F.col("signal").isin("BUY", "SELL"))
    order = (F.col("signal") == "BUY") | F.lit(sell_means == "short")
    return rows.withColumns({
        "intent": F.when(order, "order").otherwise("position"), "side": F.when(order, F.col("signal")),
        "target": F.when(~order, "FLAT"), "quantity": F.when(order, F.lit(quantity)),
    })


def size_notional(bars: DataFrame, notional: float) -> DataFrame:
    """Quantity of a fixed notional at each instrument's first close."""
    first = bars.groupBy(KEY).agg(F.min_by("close", F.struct(*ORDER)).alias("price"))
    return first.withColumn("quantity", F.when(F.col("price") > 0, F.lit(notional) / F.col("price")))


def size_vol_target(bars: DataFrame, risk: float, least: float, most: float) -> DataFrame:
    """Quantity whose money volatility meets a target, kept between a least and a most notional."""
    rows = REGISTRY.compute(bars, ["log_return"])
    out = rows.groupBy(KEY).agg(F.min_by("close", F.struct(*ORDER)).alias("price"), F.stddev_pop("log_return").alias("vol"))
    wanted = F.lit(risk) / F.col("vol")
    capped = F.greatest(F.least(wanted, F.lit(most)), F.lit(least))
    status = F.when(F.col("vol").isNull() | (F.col("vol") <= 0) | (F.col("price") <= 0), "no_volatility").when(wanted > most, "max_cap").when(wanted < least, "min_cap").otherwise("ok")
    out = out.withColumn("status", status)
    return out.withColumn("quantity", F.when(F.col("status") != "no_volatility", capped / F.col("price")))
