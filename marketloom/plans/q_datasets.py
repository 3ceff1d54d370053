"""Queries of joins, labels, splits and datasets with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.functions.features import REGISTRY
from marketloom.operators import joins as J
from marketloom.operators import labels as L
from marketloom.operators.bars import trading_date
from marketloom.plans import views as V
from marketloom.plans.q_features import EXPR, LINE, NUDGE
from marketloom.schemas import HOUR

QUERIES, ORACLES = {}, {}
BASE = f"WITH {V.sql('v_bars')}"
_4H = 4 * HOUR


def rnd(c: str) -> F.Column:
    return F.round(F.col(c).cast("double") + NUDGE, 6).alias(c)


def rs(e: str, c: str | None = None) -> str:
    return f"round({e} + {NUDGE}, 6) AS {c or e}"


def _sets(s, d):
    """Two feature sets on different grids: hourly closes, and volumes every four hours."""
    bars = V.bars(s, d)
    return bars.select("instrument_id", "event_time_ns", "seq", "close"), bars.where(F.col("event_time_ns") % _4H == 0).select("instrument_id", "event_time_ns", "seq", "volume")


QUERIES["join_exact"] = lambda s, d: J.exact({"a": _sets(s, d)[0].drop("seq"), "b": _sets(s, d)[1].drop("seq")}).select("instrument_id", "event_time_ns", rnd("a__close"), rnd("b__volume"))
ORACLES["join_exact"] = f"{BASE} SELECT instrument_id, event_time_ns, {rs('close', 'a__close')}, {rs('volume', 'b__volume')} FROM v_bars WHERE event_time_ns % {_4H} = 0"
QUERIES["join_asof_backward"] = lambda s, d: J.backward(_sets(s, d)[0], {"b": _sets(s, d)[1]}).select("instrument_id", "event_time_ns", rnd("close"), "b__asof_time_ns", rnd("b__volume"))
ORACLES["join_asof_backward"] = f"{BASE}, r AS (SELECT * FROM v_bars WHERE event_time_ns % {_4H} = 0) SELECT a.instrument_id, a.event_time_ns, {rs('a.close', 'close')}, r.event_time_ns AS b__asof_time_ns, {rs('r.volume', 'b__volume')} FROM v_bars a ASOF LEFT JOIN r ON a.instrument_id = r.instrument_id AND a.event_time_ns >= r.event_time_ns"
QUERIES["join_asof_forward_label"] = lambda s, d: J.labelled(_sets(s, d)[0], _sets(s, d)[1], ["volume"]).select("instrument_id", "event_time_ns", "label__asof_time_ns", rnd("label__volume"))
ORACLES["join_asof_forward_label"] = f"{BASE}, r AS (SELECT * FROM v_bars WHERE event_time_ns % {_4H} = 0) SELECT a.instrument_id, a.event_time_ns, r.event_time_ns AS label__asof_time_ns, {rs('r.volume', 'label__volume')} FROM v_bars a ASOF LEFT JOIN r ON a.instrument_id = r.instrument_id AND a.event_time_ns <= r.event_time_ns"
QUERIES["join_concat"] = lambda s, d: J.concat({"a": _sets(s, d)[0], "b": _sets(s, d)[1]}).select("instrument_id", "event_time_ns", "feature_set_id", rnd("close"), rnd("volume"))
ORACLES["join_concat"] = f"{BASE} SELECT instrument_id, event_time_ns, 'a' AS feature_set_id, {rs('close')}, NULL::DOUBLE AS volume FROM v_bars UNION ALL SELECT instrument_id, event_time_ns, 'b', NULL, round(volume + {NUDGE}, 6) FROM v_bars WHERE event_time_ns % {_4H} = 0"


def _features(s, d):
    b = V.bars(s, d)
    return REGISTRY.compute(b, ["feat_sma_20"]).where(F.col("event_time_ns") % _4H == 0).select("instrument_id", "event_time_ns", "close", "feat_sma_20")


QUERIES["join_bars_features"] = lambda s, d: J.onto_bars(V.bars(s, d), _features(s, d)).select("instrument_id", "event_time_ns", rnd("close"), rnd("feat_sma_20"))
ORACLES["join_bars_features"] = f"{BASE}, f AS (SELECT *, {EXPR['feat_sma_20']} AS x FROM v_bars) SELECT instrument_id, event_time_ns, {rs('close')}, CASE WHEN event_time_ns % {_4H} = 0 THEN round(x + {NUDGE}, 6) END AS feat_sma_20 FROM f"


def _pit(s, d):
    a, b = _sets(s, d)
    t = V.trades(s, d).select("instrument_id", "event_time_ns", "seq", "price")
    return J.backward(t, {"px": a.select("instrument_id", "event_time_ns", "seq", "close"), "vol": b}).select("instrument_id", "event_time_ns", "seq", rnd("px__close"), rnd("vol__volume"))


QUERIES["join_latest_pit"] = _pit
ORACLES["join_latest_pit"] = f"""{BASE}, r AS (SELECT * FROM v_bars WHERE event_time_ns % {_4H} = 0) SELECT t.instrument_id, t.event_time_ns, t.seq, {rs('a.close', 'px__close')}, {rs('r.volume', 'vol__volume')} FROM v_trades t
  ASOF LEFT JOIN v_bars a ON t.instrument_id = a.instrument_id AND t.event_time_ns >= a.event_time_ns ASOF LEFT JOIN r ON t.instrument_id = r.instrument_id AND t.event_time_ns >= r.event_time_ns"""
QUERIES["join_cum_commission"] = lambda s, d: J.cumulative_commission(V.equity(s, d).select("run_uid", "event_time_ns"), V.fills(s, d)).select("run_uid", "event_time_ns", F.round("cumulative_commission", 4).alias("cumulative_commission"))
ORACLES["join_cum_commission"] = f"""WITH {V.sql('v_equity', 'v_fills')}, c AS (SELECT run_uid, event_time_ns, sum(commission) AS c FROM v_fills GROUP BY 1, 2), t AS (SELECT run_uid, event_time_ns, sum(c) OVER (PARTITION BY run_uid ORDER BY event_time_ns) AS c FROM c)
  SELECT e.run_uid, e.event_time_ns, round(coalesce(t.c, 0), 4) AS cumulative_commission FROM v_equity e ASOF LEFT JOIN t ON e.run_uid = t.run_uid AND e.event_time_ns >= t.event_time_ns"""
_RUNS = "runs AS (SELECT instrument_id || '-' || (event_time_ns // 604800000000000) AS run_uid, instrument_id, min(event_time_ns) AS start_ns, max(event_time_ns) AS end_ns FROM v_trades GROUP BY instrument_id, event_time_ns // 604800000000000)"


def runs(s, d):
    """A run for each instrument and week of trades."""
    week = idiv(F.col("event_time_ns"), 7 * 24 * HOUR)
    g = V.trades(s, d).groupBy("instrument_id", week.alias("w")).agg(F.min("event_time_ns").alias("start_ns"), F.max("event_time_ns").alias("end_ns"))
    return g.select(F.concat("instrument_id", F.lit("-"), F.col("w").cast("string")).alias("run_uid"), "instrument_id", "start_ns", "end_ns")


QUERIES["join_benchmark_closes"] = lambda s, d: J.benchmark_closes(runs(s, d), V.bars(s, d)).select("run_uid", rnd("first_close"), rnd("last_close"))
ORACLES["join_benchmark_closes"] = f"{BASE}, {_RUNS} SELECT run_uid, {rs('arg_min(close, event_time_ns)', 'first_close')}, {rs('arg_max(close, event_time_ns)', 'last_close')} FROM runs JOIN v_bars v ON v.instrument_id = runs.instrument_id AND v.event_time_ns BETWEEN start_ns AND end_ns GROUP BY 1"


def _rates(s, d):
    o = V.table(s, d, "orders")
    cur = F.element_at(F.array(*(F.lit(c) for c in ("USD", "EUR", "JPY", "AUD", "GBP"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    other = F.element_at(F.array(*(F.lit(c) for c in ("EUR", "JPY", "AUD", "GBP", "USD"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    pairs = o.select(F.col("o_orderkey").alias("id"), cur.alias("base"), other.alias("quote"), F.col("o_orderdate").cast("date").alias("date"))
    month, quarter = F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    base = o.select(cur.alias("currency"), month.alias("m"), quarter.alias("q"), (F.col("o_custkey") % 50 / 10.0).alias("r"))
    monthly = base.where("substring(m, 7, 1) <> '3'").groupBy("currency", F.col("m").alias("period")).agg(F.max("r").alias("rate"))
    quarterly = base.groupBy("currency", F.col("q").alias("period")).agg(F.max("r").alias("rate"))
    return J.overnight_rate(pairs, monthly.unionByName(quarterly)).select("id", "base", "quote", F.round("overnight_rate", 9).alias("overnight_rate"))


QUERIES["join_interest_rate"] = _rates
_CUR = "(['USD','EUR','JPY','AUD','GBP'])[o_orderkey % 5 + 1]"
ORACLES["join_interest_rate"] = f"""WITH p AS (SELECT o_orderkey AS id, {_CUR} AS base, (['EUR','JPY','AUD','GBP','USD'])[o_orderkey % 5 + 1] AS quote, strftime(o_orderdate, '%Y-%m') AS m,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, (o_custkey % 50) / 10.0::DOUBLE AS r FROM orders),
  rm AS (SELECT base AS c, m, max(r) AS r FROM p WHERE m[7] <> '3' GROUP BY 1, 2), rq AS (SELECT base AS c, q, max(r) AS r FROM p GROUP BY 1, 2)
  SELECT id, base, quote, round((coalesce(bm.r, bq.r) - coalesce(qm.r, qq.r)) / 365 / 100, 9) AS overnight_rate FROM p LEFT JOIN rm bm ON bm.c = base AND bm.m = p.m LEFT JOIN rq bq ON bq.c = base AND bq.q = p.q
  LEFT JOIN rm qm ON qm.c = quote AND qm.m = p.m LEFT JOIN rq qq ON qq.c = quote AND qq.q = p.q"""

# Labels and splits
SPLITS = {"train": ("2024-01-01", "2024-01-18"), "validation": ("2024-01-19", "2024-01-24"), "test": ("2024-01-25", "2024-01-29")}


def label_sql(long_at: float, short_at: float | None, source: str = "v_bars") -> str:
    short = f"WHEN fr < -{short_at} THEN 'SHORT'" if short_at is not None else ""
    return f"""lab AS (SELECT *, CASE WHEN fr IS NULL THEN NULL WHEN fr > {long_at} THEN 'LONG' {short} ELSE 'NO_TRADE' END AS label_class, fr IS NOT NULL AS is_valid FROM (
    SELECT *, lead(close, 15) OVER ({LINE}) / nullif(close, 0) - 1 AS fr, lead(event_time_ns, 15) OVER ({LINE}) AS label_horizon_ts FROM {source}))"""


_code = "CASE label_class WHEN 'NO_TRADE' THEN 0 WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 END"
_lab = ["instrument_id", "event_time_ns", "label_class", "label_code", "label_horizon_ts", "is_valid"]
QUERIES["labels_3class"] = lambda s, d: L.build(V.bars(s, d), long_at=0.1, short_at=0.1).select(*_lab, rnd("future_return"))
ORACLES["labels_3class"] = f"{BASE}, {label_sql(0.1, 0.1)} SELECT instrument_id, event_time_ns, label_class, {_code} AS label_code, label_horizon_ts, is_valid, {rs('fr', 'future_return')} FROM lab"
QUERIES["labels_variant"] = lambda s, d: L.build(V.bars(s, d), long_at=0.2, long_only=True).select(*_lab, rnd("future_return"))
ORACLES["labels_variant"] = f"{BASE}, {label_sql(0.2, None)} SELECT instrument_id, event_time_ns, label_class, {_code} AS label_code, label_horizon_ts, is_valid, {rs('fr', 'future_return')} FROM lab"
QUERIES["label_distribution"] = lambda s, d: L.distribution(L.build(V.bars(s, d), long_at=0.1, short_at=0.1))
ORACLES["label_distribution"] = f"{BASE}, {label_sql(0.1, 0.1)} SELECT label_class, count(*) AS n FROM lab WHERE is_valid GROUP BY 1"


def split_sql(time: str) -> str:
    day = f"CAST(make_timestamp({time} // 1000) AS DATE)"
    return "CASE " + " ".join(f"WHEN {day} BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in SPLITS.items()) + " END"


QUERIES["split_assign"] = lambda s, d: L.assign(V.bars(s, d), SPLITS).select("instrument_id", "event_time_ns", "split")
ORACLES["split_assign"] = f"{BASE} SELECT instrument_id, event_time_ns, {split_sql('event_time_ns')} AS split FROM v_bars"
_SP = f"sp AS (SELECT *, {split_sql('event_time_ns')} AS split, {split_sql('label_horizon_ts')} AS end_split FROM lab)"
_LEAK = "(split IS NOT NULL AND label_horizon_ts IS NOT NULL AND end_split IS DISTINCT FROM split)"
QUERIES["split_purge"] = lambda s, d: L.purge(L.assign(L.build(V.bars(s, d), long_at=0.1, short_at=0.1), SPLITS), SPLITS).select("instrument_id", "event_time_ns", "split", "label_class")
ORACLES["split_purge"] = f"{BASE}, {label_sql(0.1, 0.1)}, {_SP} SELECT instrument_id, event_time_ns, split, label_class FROM sp WHERE NOT {_LEAK}"
QUERIES["split_summary"] = lambda s, d: L.summary(L.assign(V.bars(s, d), SPLITS))
ORACLES["split_summary"] = f"{BASE} SELECT {split_sql('event_time_ns')} AS split, count(*) AS n FROM v_bars WHERE {split_sql('event_time_ns')} IS NOT NULL GROUP BY 1"


def dataset_parts(names: list[str], long_at: float, short_at: float | None) -> str:
    """WITH list up to `ds`: one row per bar with drop_reason."""
    ctes, last = [V.sql("v_bars")], "v_bars"
    ctes.append(f"numbered AS (SELECT *, {EXPR['rn_']} AS rn_ FROM {last})")
    last = "numbered"
    for k, level in enumerate(REGISTRY.levels(names)):
        made = ", ".join(f"{EXPR[n]} AS {n}" for n in level if n != "rn_")
        if made:
            ctes.append(f"l{k} AS (SELECT *, {made} FROM {last})")
            last = f"l{k}"
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    ctes += [label_sql(long_at, short_at, last), _SP, f"w AS (SELECT *, {whole} AS whole, min(CASE WHEN {whole} THEN event_time_ns END) OVER (PARTITION BY instrument_id) AS first_ok FROM sp)"]
    ctes.append(f"ds AS (SELECT *, CASE WHEN split IS NULL THEN 'no_split' WHEN NOT is_valid THEN 'horizon' WHEN {_LEAK} THEN 'purge' WHEN first_ok IS NULL OR event_time_ns < first_ok THEN 'warmup' WHEN NOT whole THEN 'nan_feature' END AS drop_reason FROM w)")
    return "WITH " + ", ".join(ctes)


def _dataset(names, **label):
    return lambda s, d: L.dataset(V.bars(s, d), names, SPLITS, **label)


for _name, _names, _long, _short in (("dataset_v1", L.V1_FEATURES, 0.1, 0.1), ("dataset_v2", L.V2_FEATURES, 0.1, 0.1), ("dataset_variant", L.V2_FEATURES, 0.2, None)):
    _make = _dataset(_names, long_at=_long, short_at=_short or 0.0, long_only=_short is None)
    _show = [n for n in _names if "trend_slope" in n or "imbalance_15" in n or "return_5" in n]
    QUERIES[_name] = lambda s, d, m=_make, n=_show: m(s, d).select("instrument_id", "event_time_ns", "split", "label_class", "drop_reason", *map(rnd, n))
    ORACLES[_name] = f"{dataset_parts(_names, _long, _short)} SELECT instrument_id, event_time_ns, split, label_class, drop_reason, {', '.join(rs(n) for n in _show)} FROM ds"
_make = _dataset(L.V1_FEATURES, long_at=0.1, short_at=0.1)
QUERIES["dataset_drop_summary"] = lambda s, d: L.drop_summary(_make(s, d))
ORACLES["dataset_drop_summary"] = f"{dataset_parts(L.V1_FEATURES, 0.1, 0.1)} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM ds GROUP BY 1"
QUERIES["dataset_class_rollup"] = lambda s, d: L.class_rollup(_make(s, d))
ORACLES["dataset_class_rollup"] = f"{dataset_parts(L.V1_FEATURES, 0.1, 0.1)} SELECT split, label_class, count(*) AS n FROM ds WHERE drop_reason IS NULL GROUP BY ROLLUP (split, label_class)"
QUERIES["dataset_partitioned"] = lambda s, d: L.typed(L.kept(_make(s, d)), ["f_return_1"]).select("instrument_id", "event_time_ns", "split", F.date_format(trading_date(), "yyyy-MM").alias("month"), rnd("close_t"), F.col("label_code").cast("int").alias("label_code"), F.round(F.col("f_return_1").cast("double"), 4).alias("f_return_1"))
ORACLES["dataset_partitioned"] = f"{dataset_parts(L.V1_FEATURES, 0.1, 0.1)} SELECT instrument_id, event_time_ns, split, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m') AS month, {rs('close', 'close_t')}, {_code} AS label_code, round(f_return_1::FLOAT::DOUBLE, 4) AS f_return_1 FROM ds WHERE drop_reason IS NULL"
