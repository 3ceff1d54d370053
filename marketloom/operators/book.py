"""Order-book depth, option chains, swaps and funding as table operations.

Depth rows are (snapshot_id, instrument_id, side, level, price, size), level 1 the best. A
snapshot's levels are few, so windows over (snapshot, side) are small and spread by snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import scan

SIDE = ["snapshot_id", "side"]


def _better(price: Column, limit: Column) -> Column:
    """Whether a level's price is at the limit or better for who takes it: asks for buyers."""
    return F.when(F.col("side") == "ASK", price <= limit).otherwise(price >= limit)


def levels_for_price(depth: DataFrame, limits: DataFrame) -> DataFrame:
    """Levels at or better than a limit. limits: snapshot_id, side, limit."""
    return depth.join(limits, SIDE).where(_better(F.col("price"), F.col("limit"))).drop("limit")


def quantity_for_price(depth: DataFrame, limits: DataFrame) -> DataFrame:
    return levels_for_price(depth, limits).groupBy(*SIDE).agg(F.sum("size").alias("quantity"))


def _taken(depth: DataFrame, quantity: float) -> DataFrame:
    """Part of each level that an order of the quantity takes."""
    before = Window.partitionBy(*SIDE).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(quantity) - F.coalesce(F.sum("size").over(before), F.lit(0.0))
    return depth.withColumn("taken", F.greatest(F.least(F.col("size"), left), F.lit(0.0)))


def average_price(depth: DataFrame, quantity: float) -> DataFrame:
    """Mean and worst price of filling a quantity, and how much of it the book holds."""
    t = _taken(depth, quantity)
    filled = F.sum("taken")
    return t.groupBy(*SIDE).agg(
        F.coalesce(F.sum(F.col("price") * F.col("taken")) / F.nullif(filled, F.lit(0.0)), F.lit(0.0)).alias("avg_price"),
        F.max_by("price", F.when(F.col("taken") > 0, F.col("level"))).alias("worst_price"), filled.alias("filled"),
    )


def price_for_exposure(depth: DataFrame, exposure: float, lot: float = 0.01) -> DataFrame:
    """Mean price, quantity and last price of spending a notional, in whole lots per level.

    Full levels are whole lots, so only the last level taken can be rounded down."""
    before = Window.partitionBy(*SIDE).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    notional = F.col("price") * F.col("size")
    left = F.lit(exposure) - F.coalesce(F.sum(notional).over(before), F.lit(0.0))
    part = F.floor(F.greatest(F.least(notional, left), F.lit(0.0)) / F.col("price") / lot + 1e-9) * lot
    t = depth.where("price <> 0").withColumn("taken", part)
    return t.groupBy(*SIDE).agg(
        F.coalesce(F.sum(F.col("price") * F.col("taken")) / F.nullif(F.sum("taken"), F.lit(0.0)), F.lit(0.0)).alias("avg_price"), F.sum("taken").alias("quantity"),
        F.coalesce(F.max_by("price", F.when(F.col("taken") > 0, F.col("level"))), F.min_by("price", "level")).alias("final_price"),
    )


def integrity(depth: DataFrame, most_levels: int) -> DataFrame:
    """Snapshots whose best bid is above the best ask, or with too many levels on a side."""
    bid, ask = F.max(F.when(F.col("side") == "BID", F.col("price"))), F.min(F.when(F.col("side") == "ASK", F.col("price")))
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    out = depth.groupBy("snapshot_id").agg(bid.alias("bid"), ask.alias("ask"), F.greatest(n("BID"), n("ASK")).alias("levels"))
    out = out.withColumn("crossed", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False))).withColumn("too_deep", F.col("levels") > most_levels)
    return out.where("crossed or too_deep")


GREEKS = ("delta", "gamma", "vega", "theta", "pnl", "price")


def portfolio_greeks(rows: DataFrame, *keys: str) -> DataFrame:
    """Greeks of a portfolio: sums weighted by quantity and multiplier."""
    weight = F.col("quantity") * F.col("multiplier")
    return rows.groupBy(*keys).agg(*(F.sum(weight * F.col(g)).alias(g) for g in GREEKS))


def strikes_near(strikes: DataFrame, above: int, below: int) -> DataFrame:
    """Strikes from `below` under to `above` over the one nearest to `atm` (the lower of ties).

    strikes: series, strike, atm. Series without atm give none."""
    line = Window.partitionBy("series").orderBy("strike")
    near = Window.partitionBy("series")
    rows = strikes.where("atm is not null").withColumn("k_", F.row_number().over(line))
    rows = rows.withColumn("at_", F.min_by("k_", F.struct(F.abs(F.col("strike") - F.col("atm")), "strike")).over(near))
    return rows.where(F.col("k_").between(F.col("at_") - below, F.col("at_") + above)).drop("k_", "at_")


def strikes_within(strikes: DataFrame, share: float) -> DataFrame:
    """Strikes within a share of atm; all if atm is 0."""
    return strikes.where((F.col("atm") == 0) | (F.abs((F.col("strike") - F.col("atm")) / F.nullif(F.col("atm"), F.lit(0.0))) <= share))


def option_chain(quotes: DataFrame) -> DataFrame:
    """Latest bid and ask of the call and the put of each strike, side by side.

    quotes: series, strike, kind (CALL or PUT), event_time_ns, seq, bid, ask."""
    at = F.struct("event_time_ns", "seq")
    pick = lambda k, c: F.max_by(F.when(F.col("kind") == k, F.col(c)), F.when(F.col("kind") == k, at))
    return quotes.groupBy("series", "strike").agg(*(pick(k, c).alias(f"{k.lower()}_{c}") for k in ("CALL", "PUT") for c in ("bid", "ask")))


def swap_impact(swaps: DataFrame) -> DataFrame:
    """Price impact and slippage of each swap in basis points of the price before it.

    swaps: pool, block, tx, log, spot_price, execution_price; a pool's first swap has none."""
    keys = {"keys": ("pool",), "order": ("block", "tx", "log")}
    line = Window.partitionBy("pool", "block_").orderBy("block", "tx", "log")
    rows = scan.home(scan.halo(swaps, 1, width=10_000, **keys).withColumn("spot_before", F.lag("spot_price").over(line)))
    bps = lambda c: F.round(F.abs((F.col(c) - F.col("spot_before")) / F.nullif(F.col("spot_before"), F.lit(0.0))) * 10_000)
    return rows.withColumns({"impact_bps": bps("spot_price"), "slippage_bps": bps("execution_price")})


def funding_cost(positions: DataFrame, rates: DataFrame) -> DataFrame:
    """Positions with the latest funding rate at their time and what it costs.

    positions: instrument_id, event_time_ns, seq, quantity, price; rates: ..., rate."""
    found = scan.as_of(positions, rates, ["rate"], prefix="funding_")
    return found.withColumn("funding_cost", F.col("quantity") * F.col("price") * F.col("funding_rate"))
