"""Queries of reports with their oracles: orders and their lines as orders with fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import reports as P
from marketloom.plans import q_features
from marketloom.plans import views as V

QUERIES, ORACLES = {}, {}


def _orders(s, d):
    o, x = V.table(s, d, "orders"), V.table(s, d, "lineitem")
    filled = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0))
    trade = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), V.ns("l_shipdate").alias("ts_event"), F.col("l_quantity").alias("last_qty"), F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-7, 4).alias("last_px"))
    lines = x.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), filled.alias("filled_qty"), F.collect_list(F.when(F.col("l_linestatus") == "F", trade)).alias("fills"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("order_id"), V.ns("o_orderdate").alias("ts_init"), F.col("o_orderstatus").alias("status"), "quantity", "filled_qty", "fills")


_OR = "od AS (SELECT o_orderkey AS order_id, epoch_us(o_orderdate) * 1000 AS ts_init, any_value(o_orderstatus) AS status, sum(l_quantity) AS quantity, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS filled_qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
QUERIES["report_orders"] = lambda s, d: P.orders(_orders(s, d).drop("fills"))
ORACLES["report_orders"] = f"WITH {_OR} SELECT * FROM od"
QUERIES["report_order_fills"] = lambda s, d: P.order_fills(_orders(s, d).drop("fills")).withColumn("filled_share", F.round(F.col("filled_share") + 1e-9, 6))
ORACLES["report_order_fills"] = f"WITH {_OR} SELECT *, round(filled_qty / nullif(quantity, 0) + 1e-9, 6) AS filled_share FROM od WHERE filled_qty > 0"
QUERIES["report_fills"] = lambda s, d: P.fills(_orders(s, d))
ORACLES["report_fills"] = "SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS trade_id, epoch_us(l_shipdate) * 1000 AS ts_event, l_quantity AS last_qty, round(l_extendedprice / l_quantity + 1e-7, 4) AS last_px FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'"


def _positions(s, d):
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("position_id"), V.ns("o_orderdate").alias("ts_opened"), F.when(F.col("o_orderkey") % 3 == 0, "FLAT").when(F.col("o_orderkey") % 3 == 1, "LONG").otherwise("SHORT").alias("side"))


QUERIES["report_positions"] = lambda s, d: P.positions(_positions(s, d), _positions(s, d).where("position_id % 5 = 0"))
_po = "po AS (SELECT o_orderkey AS position_id, epoch_us(o_orderdate) * 1000 AS ts_opened, CASE o_orderkey % 3 WHEN 0 THEN 'FLAT' WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS side FROM orders)"
ORACLES["report_positions"] = f"WITH {_po} SELECT *, false AS is_snapshot FROM po WHERE side <> 'FLAT' UNION ALL SELECT *, true FROM po WHERE position_id % 5 = 0"


def _account(s, d):
    c = V.table(s, d, "customer")
    balance = lambda cur, x: F.struct(F.lit(cur).alias("currency"), x.alias("total"))
    return P.account(c.select(F.col("c_custkey").alias("account_id"), (F.col("c_custkey") * 1000).alias("ts_event"), F.array(balance("USD", F.col("c_acctbal")), balance("EUR", F.round(F.col("c_acctbal") / 2 + 1e-7, 4))).alias("balances")))


QUERIES["report_account"] = _account
ORACLES["report_account"] = "SELECT c_custkey AS account_id, c_custkey * 1000 AS ts_event, 'USD' AS currency, c_acctbal AS total FROM customer UNION ALL SELECT c_custkey, c_custkey * 1000, 'EUR', round(c_acctbal / 2 + 1e-7, 4) FROM customer"
for _new, _what in (("return_n", "return"), ("momentum_n", "momentum")):
    _names = [f"{_what}_{n}" for n in (10, 30)]
    QUERIES[_new] = lambda s, d, names=_names: q_features.rounded(q_features.REGISTRY.compute(V.bars(s, d), names), names)
    _expr = {"return": "CASE WHEN abs({0}) >= {1} THEN close / {0} - 1 END", "momentum": "close - {0}"}[_what]
    _cols = ", ".join(f"round({_expr.format(q_features.lag('close', n), q_features.E)} + {q_features.NUDGE}, 6) AS {_what}_{n}" for n in (10, 30))
    ORACLES[_new] = f"WITH {V.sql('v_bars')} SELECT instrument_id, event_time_ns, seq, {_cols} FROM v_bars"
