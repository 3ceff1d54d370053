"""Point-in-time joins of feature sets, bars, fills and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import scan
from marketloom.schemas import DAY, KEY

TIME = "event_time_ns"


def exact(sets: dict[str, DataFrame], keys=(KEY, TIME)) -> DataFrame:
    """Inner join of feature sets on their keys; columns become set__column."""
    named = [df.select(*keys, *(F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in keys)) for name, df in sets.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), named)


def backward(primary: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Each primary row with the latest row of every set at or before its time."""
    for name, df in sets.items():
        columns = [c for c in df.columns if c not in (KEY, TIME, "seq")]
        primary = scan.as_of(primary, df, columns, prefix=f"{name}__")
    return primary


def labelled(features: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Each feature row with the first label row at or after its time."""
    return scan.as_of(features, labels, columns, prefix="label__", forward=True)


def concat(sets: dict[str, DataFrame]) -> DataFrame:
    """Feature sets below each other, with the set's name; missing columns are null."""
    named = [df.withColumn("feature_set_id", F.lit(name)) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def onto_bars(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Bars with their features by instrument and time; columns that bars have already are not
    taken again."""
    fresh = [c for c in features.columns if c not in bars.columns]
    return bars.join(features.select(KEY, TIME, *fresh), [KEY, TIME], "left")


def cumulative_commission(bars: DataFrame, fills: DataFrame, key: str = "run_uid") -> DataFrame:
    """Each bar with the sum of commissions of fills at or before its time.

    Sides are unioned and summed in day buckets, with the days before carried over their totals.
    """
    a = bars.select(*bars.columns, F.lit(0.0).alias("x_"), F.lit(1).alias("side_"))
    b = fills.select(key, TIME, F.col("commission").alias("x_"), F.lit(0).alias("side_"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("day_", idiv(F.col(TIME), DAY))
    totals = rows.groupBy(key, "day_").agg(F.sum("x_").alias("t_"))
    before = Window.partitionBy(key).orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "day_", F.coalesce(F.sum("t_").over(before), F.lit(0.0)).alias("s_"))
    line = Window.partitionBy(key, "day_").orderBy(TIME).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c_", F.sum("x_").over(line)).where("side_ = 1")
    out = rows.join(starts, [key, "day_"]).withColumn("cumulative_commission", F.col("s_") + F.col("c_"))
    return out.select(*bars.columns, "cumulative_commission")


def benchmark_closes(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """First and last close of a run's instrument inside the run's window.

    runs: run_uid, instrument_id, start_ns, end_ns. Runs are cut into days, so that the join has
    equal keys; each bar belongs to one day of each run at most.
    """
    days = runs.withColumn("day_", F.explode(F.sequence(idiv(F.col("start_ns"), DAY), idiv(F.col("end_ns"), DAY))))
    b = bars.withColumn("day_", idiv(F.col(TIME), DAY)).select(KEY, "day_", TIME, "close")
    j = days.join(b, [KEY, "day_"]).where(f"{TIME} between start_ns and end_ns")
    return j.groupBy("run_uid").agg(F.min_by("close", TIME).alias("first_close"), F.max_by("close", TIME).alias("last_close"))


def overnight_rate(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Overnight rate difference of a currency pair at a date: (base - quote) / 365 / 100.

    rates: currency, period (YYYY-MM or YYYY-Qn), rate; the month's rate comes before the
    quarter's. The rate table is small by nature; Spark broadcasts it if it is.
    """
    month = F.date_format("date", "yyyy-MM")
    quarter = F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string"))
    out = pairs.withColumn("month_", month).withColumn("quarter_", quarter)
    for side in ("base", "quote"):
        for period in ("month", "quarter"):
            r = rates.select(F.col("currency").alias(side), F.col("period").alias(f"{period}_"), F.col("rate").alias(f"{side}_{period}"))
            out = out.join(r, [side, f"{period}_"], "left")
    rate: dict[str, Column] = {s: F.coalesce(f"{s}_month", f"{s}_quarter") for s in ("base", "quote")}
    return out.withColumn("overnight_rate", (rate["base"] - rate["quote"]) / 365 / 100).select(*pairs.columns, "overnight_rate")
