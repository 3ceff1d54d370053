"""Tabular reports of orders, fills, positions and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orders(rows: DataFrame) -> DataFrame:
    """Every order, by time and id."""
    return rows.orderBy("ts_init", "order_id")


def order_fills(rows: DataFrame) -> DataFrame:
    """Orders with something filled, and the share of them that was."""
    return rows.where("filled_qty > 0").withColumn("filled_share", F.col("filled_qty") / F.nullif(F.col("quantity"), F.lit(0.0))).orderBy("ts_init", "order_id")


def fills(rows: DataFrame) -> DataFrame:
    """One row per fill, from orders with an array of fills."""
    return rows.select("order_id", F.explode("fills").alias("f")).select("order_id", "f.*").orderBy("ts_event", "order_id", "trade_id")


def positions(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Positions and snapshots of closed ones in one table, flagged; a flat entry never shows."""
    both = current.withColumn("is_snapshot", F.lit(False)).unionByName(snapshots.withColumn("is_snapshot", F.lit(True)), allowMissingColumns=True)
    return both.where("side <> 'FLAT' or is_snapshot").orderBy("ts_opened", "position_id", "is_snapshot")


def account(states: DataFrame) -> DataFrame:
    """One row per balance of each account state, from states with an array of balances."""
    return states.select("account_id", "ts_event", F.explode("balances").alias("b")).select("account_id", "ts_event", "b.*").orderBy("ts_event", "account_id", "currency")
