"""Queries of model evaluation with their oracles, and of fitting (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import labels as L
from marketloom.operators import ml as M
from marketloom.plans import views as V
from marketloom.plans.q_datasets import SPLITS, label_sql
from marketloom.plans.q_features import NUDGE
from marketloom.schemas import DAY

QUERIES, ORACLES = {}, {}
FEATURES = ["f_return_1", "f_return_5", "f_rolling_vol_30", "f_bollinger_z_60", "f_time_of_day_sin"]


#: Columns and moduli that two models' probabilities are derived from.
MODELS = {"a": (("open", 97), ("high", 89), ("volume", 83)), "b": (("low", 71), ("high", 89), ("close", 97))}


def predictions(s, d, model: str = "a"):
    """Labels with probabilities derived from prices and volumes."""
    b = L.build(V.bars(s, d), long_at=0.1, short_at=0.1).where("is_valid")
    a, c, e = ((F.floor(F.col(x) * 100) % m + 1).cast("double") for x, m in MODELS[model])
    total = a + c + e
    row = F.concat("instrument_id", F.lit("-"), F.col("event_time_ns").cast("string"))
    out = b.select(row.alias("row_id"), "event_time_ns", F.col("label_code").alias("y"), "future_return", (a / total).alias("p_notrade"), (c / total).alias("p_long"), (e / total).alias("p_short"))
    return out.withColumn("predicted", M.likeliest())


def _pr(model: str) -> str:
    a, c, e = (f"(CAST(floor({c} * 100) AS BIGINT) % {m} + 1)::DOUBLE" for c, m in MODELS[model])
    return f"""q{model} AS (SELECT instrument_id || '-' || event_time_ns AS row_id, event_time_ns, CASE label_class WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 0 END AS y, fr AS future_return, {a} AS a, {c} AS c, {e} AS e FROM lab WHERE is_valid),
  pr{model} AS (SELECT row_id, event_time_ns, y, future_return, a / (a + c + e) AS pn, c / (a + c + e) AS pl, e / (a + c + e) AS ps, CASE WHEN e >= greatest(a, c) THEN 2 WHEN a >= c THEN 0 ELSE 1 END AS p FROM q{model})"""


PR = f"WITH {V.sql('v_bars')}, {label_sql(0.1, 0.1)}, {_pr('a')}, pr AS (SELECT * FROM pra)"
CL = "cl AS (SELECT k AS class, count(*) FILTER (y = k) AS support, count(*) FILTER (p = k) AS predicted, count(*) FILTER (y = k AND p = k) AS hits FROM pr, (VALUES (0), (1), (2)) t(k) GROUP BY k), sc AS (SELECT *, hits / nullif(predicted, 0)::DOUBLE AS precision, hits / nullif(support, 0)::DOUBLE AS recall, 2 * hits / nullif(support + predicted, 0)::DOUBLE AS f1 FROM cl)"
rnd = lambda c: F.round(F.col(c) + NUDGE, 6).alias(c)
rs = lambda e, c: f"round({e} + {NUDGE}, 6) AS {c}"
QUERIES["ml_class_scores"] = lambda s, d: M.class_scores(predictions(s, d)).select("class", "support", "predicted", "hits", rnd("precision"), rnd("recall"), rnd("f1"))
ORACLES["ml_class_scores"] = f"{PR}, {CL} SELECT class, support, predicted, hits, {rs('precision', 'precision')}, {rs('recall', 'recall')}, {rs('f1', 'f1')} FROM sc"
_MEANS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
_PROBS = ("max_prob_mean", *M.POINTS, "avg_p_notrade", "avg_p_long", "avg_p_short")


def _eval(s, d):
    p = predictions(s, d)
    return M.evaluate(p).withColumn("k", F.lit(1)).join(M.probability_summary(p).withColumn("k", F.lit(1)), "k").select(*map(rnd, (*_MEANS, *_PROBS)))


QUERIES["ml_eval"] = _eval
_quantiles = ", ".join(f"quantile_cont(greatest(pn, pl, ps), {q}) AS {name}" for name, q in M.POINTS.items())
ORACLES["ml_eval"] = f"""{PR}, {CL}, pb AS (SELECT avg(greatest(pn, pl, ps)) AS max_prob_mean, {_quantiles}, avg(pn) AS avg_p_notrade, avg(pl) AS avg_p_long, avg(ps) AS avg_p_short FROM pr),
  ev AS (SELECT sum(hits) / sum(support)::DOUBLE AS accuracy, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM sc)
  SELECT {', '.join(rs(c, c) for c in (*_MEANS, *_PROBS))} FROM ev, pb"""
QUERIES["ml_confusion"] = lambda s, d: M.confusion(predictions(s, d)).select("y", "predicted", "n")
ORACLES["ml_confusion"] = f"{PR} SELECT a.k AS y, b.k AS predicted, count(pr.y) AS n FROM (VALUES (0), (1), (2)) a(k) CROSS JOIN (VALUES (0), (1), (2)) b(k) LEFT JOIN pr ON pr.y = a.k AND pr.p = b.k GROUP BY 1, 2"
LEVELS, SHARES, COST, AT, LEAST = [0.4, 0.5, 0.6], [0.01, 0.05, 0.2, 0.9], 0.002, 0.1, 20
_RATES = ("coverage", "per_day", "precision", "wrong_rate", "no_trade_rate", "avg_return", "median_return", "positive_rate", "label_hit_rate", "net_of_cost", "net_of_label")
_rates = ", ".join(rs(c, c) for c in _RATES)
QUERIES["ml_threshold_analysis"] = lambda s, d: M.thresholds(predictions(s, d), LEVELS, COST, AT).select("threshold", "kind", "signals", *map(rnd, _RATES))


def _stats(name: str, source: str, key: str, values: list[float]) -> str:
    """SQL of signal_stats: source has the key, p (the side), y and future_return of each signal."""
    groups = f"(SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in values)}]) AS {key}) g CROSS JOIN (VALUES ('long'), ('short'), ('both')) k(kind)"
    return f"""sg{name} AS (SELECT {key}, p, y, CASE p WHEN 1 THEN future_return ELSE -future_return END AS sr, CASE p WHEN 1 THEN 'long' ELSE 'short' END AS kind FROM {source}),
  sb{name} AS (SELECT * FROM sg{name} UNION ALL SELECT {key}, p, y, sr, 'both' FROM sg{name}),
  ag{name} AS (SELECT {key}, kind, count(*) AS signals, avg((y = p)::INT) AS precision, avg((y = 3 - p)::INT) AS wrong_rate, avg((y = 0)::INT) AS no_trade_rate, avg(sr) AS avg_return, median(sr) AS median_return, avg((sr > 0)::INT) AS positive_rate,
    avg((sr > {AT})::INT) AS label_hit_rate, avg(sr - {COST}) AS net_of_cost, avg(sr - {AT}) AS net_of_label FROM sb{name} GROUP BY 1, 2),
  st{name} AS (SELECT {key}, kind, coalesce(signals, 0) AS signals, coalesce(signals, 0) / t.n::DOUBLE AS coverage, coalesce(signals, 0) / t.days::DOUBLE AS per_day, precision, wrong_rate, no_trade_rate, avg_return, median_return, positive_rate, label_hit_rate, net_of_cost, net_of_label
    FROM {groups} LEFT JOIN ag{name} USING ({key}, kind), (SELECT count(*) AS n, count(DISTINCT event_time_ns // {DAY}) AS days FROM pr) t)"""


_levels = lambda pr: f"(SELECT * FROM {pr}, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVELS)}]) AS threshold) WHERE CASE p WHEN 1 THEN pl WHEN 2 THEN ps END >= threshold)"
TH = _stats("a", _levels("pr"), "threshold", LEVELS)
ORACLES["ml_threshold_analysis"] = f"{PR}, {TH} SELECT threshold, kind, signals, {_rates} FROM sta"
QUERIES["ml_best_threshold"] = lambda s, d: M.best_threshold(M.thresholds(predictions(s, d), LEVELS, COST, AT), "precision", LEAST).select("threshold", "signals", rnd("precision"))
ORACLES["ml_best_threshold"] = f"{PR}, {TH} SELECT threshold, signals, {rs('precision', 'precision')} FROM sta WHERE kind = 'both' AND signals >= {LEAST} ORDER BY sta.precision DESC, threshold LIMIT 1"
QUERIES["ml_top_pct"] = lambda s, d: M.top_share(predictions(s, d), 0.9).select("row_id", "y", "predicted", rnd("confidence"))
_top = "SELECT *, CASE p WHEN 1 THEN pl WHEN 2 THEN ps ELSE -1 END AS confidence, row_number() OVER (ORDER BY CASE p WHEN 1 THEN pl WHEN 2 THEN ps ELSE -1 END DESC, row_id) AS place, count(*) OVER () AS n FROM pr"
ORACLES["ml_top_pct"] = f"{PR} SELECT row_id, y, p AS predicted, {rs('confidence', 'confidence')} FROM ({_top}) WHERE place <= CAST(floor(n * 0.9 + 1e-9) AS BIGINT) AND confidence >= 0"
QUERIES["ml_top_pct_stats"] = lambda s, d: M.top_stats(predictions(s, d), SHARES, COST, AT).select("share", "kind", "signals", rnd("confidence_floor"), *map(rnd, _RATES))
TP = f"tp AS (SELECT t.*, share FROM ({_top}) t, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in SHARES)}]) AS share) WHERE place <= CAST(floor(n * share + 1e-9) AS BIGINT) AND confidence >= 0)"
ORACLES["ml_top_pct_stats"] = f"{PR}, {TP}, {_stats('a', 'tp', 'share', SHARES)}, fl AS (SELECT share, min(confidence) AS confidence_floor FROM tp GROUP BY 1) SELECT share, kind, signals, {rs('confidence_floor', 'confidence_floor')}, {_rates} FROM sta LEFT JOIN fl USING (share)"
_BEST = ("threshold", "signals", "precision", "avg_return", "per_day")


def _compare(s, d):
    a, b = (M.thresholds(predictions(s, d, m), LEVELS, COST, AT) for m in MODELS)
    return M.compare(a, b, LEAST).select(*((rnd if c not in ("threshold", "signals") else F.col)(f"{m}_{c}") for m in ("base", "other") for c in _BEST), "beats")


QUERIES["ml_compare"] = _compare
_pick = lambda m, st: f"(SELECT * FROM {st} WHERE kind = 'both' AND signals >= {LEAST} ORDER BY net_of_cost DESC, threshold LIMIT 1) {m} ON true"
_best = ", ".join(f"{m}.{c} AS {m}_{c}" if c in ("threshold", "signals") else rs(f"{m}.{c}", f"{m}_{c}") for m in ("base", "other") for c in _BEST)
ORACLES["ml_compare"] = f"{PR}, {_pr('b')}, {TH}, {_stats('b', _levels('prb'), 'threshold', LEVELS)} SELECT {_best}, coalesce(other.precision > 0.5 AND other.avg_return > 0.0015 AND other.per_day > coalesce(base.per_day, 0) AND base.threshold IS NOT NULL, false) AS beats FROM (SELECT 1) LEFT JOIN {_pick('base', 'sta')} LEFT JOIN {_pick('other', 'stb')}"


def _train(s, d):
    """Probabilities of the held-out rows by a model fitted on the training split."""
    rows = L.kept(L.dataset(V.bars(s, d), FEATURES, SPLITS, long_at=0.1, short_at=0.1))
    predict = M.fit_logistic(rows.where("split = 'train'").select("label_code", *FEATURES), FEATURES)
    return predict(rows.where("split <> 'train'")).select("instrument_id", "event_time_ns", "split", "label_code", "predicted", *(F.round(c, 6).alias(c) for c in ("p_notrade", "p_long", "p_short")))


QUERIES["ml_baseline_train"] = _train


def _boosted(s, d):
    """Boosted trees on the training split, stopped by the validation split: its probabilities."""
    rows = L.kept(L.dataset(V.bars(s, d), FEATURES, SPLITS, long_at=0.1, short_at=0.1))
    train, held = (rows.where(f"split {op} 'train'").select("instrument_id", "event_time_ns", "split", "label_code", *FEATURES) for op in ("=", "<>"))
    predict = M.fit_boosted(train, FEATURES, valid=held.where("split = 'validation'"), rounds=6, patience=2)
    return predict(held).select("instrument_id", "event_time_ns", "split", "label_code", "predicted", *(F.round(c, 6).alias(c) for c in ("p_notrade", "p_long", "p_short")))


QUERIES["ml_boosted_train"] = _boosted
