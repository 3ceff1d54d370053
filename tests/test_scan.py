"""Scan primitives on random histories: any block size gives the answer of one pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.features import Registry
from marketloom.functions.ints import idiv
from marketloom.operators import bars, indicators, joins, labels, ml, scan
from marketloom.schemas import DAY, HOUR

KEYS = "instrument_id string, event_time_ns long, seq long"


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(1)
    rows = [("A" if i % 3 else "B", int(t), i, float(x)) for i, (t, x) in enumerate(zip(rng.integers(0, 5 * DAY, 300), rng.normal(100, 5, 300)))]
    rows += [("A", 7 * DAY, 1000, 1.0), ("A", 7 * DAY, 1001, 2.0), ("C", DAY, 1002, 3.0)]  # ties, a gap, a single row
    return spark.createDataFrame(rows, KEYS + ", x double").cache()


def ordered(df, *cols):
    return df.select("instrument_id", "event_time_ns", "seq", *cols).toPandas().sort_values(["instrument_id", "event_time_ns", "seq"]).reset_index(drop=True)


@pytest.mark.parametrize("block", [3, 50, 10**6])
def test_halo_windows(history, block):
    line = Window.partitionBy("instrument_id", "block_").orderBy("event_time_ns", "seq").rowsBetween(-6, 2)
    got = ordered(scan.home(scan.halo(history, 6, 2, block=block).withColumn("s", F.sum("x").over(line))), "s")
    p = ordered(history, "x")
    want = pd.concat([g.x.rolling(9, min_periods=1).sum().shift(-2).where(lambda v: v.index <= g.index[-1] - 2) for _, g in p.groupby("instrument_id")])
    ok = want.notna() & (p.groupby("instrument_id").cumcount() >= 6)
    assert np.allclose(got.s[ok], want[ok]) and len(got) == len(p)


@pytest.mark.parametrize("block", [4, 10**6])
def test_prefix_max_and_affine(history, block):
    p = ordered(history, "x")
    got = ordered(scan.prefix(history, {"t": F.col("x")}, block=block), "t")
    assert np.allclose(got.t, p.groupby("instrument_id").x.cumsum())
    got = ordered(scan.running_max(history, "x", "m", block=block), "m")
    assert np.allclose(got.m, p.groupby("instrument_id").x.cummax())
    got = ordered(scan.ema(history, {"e": ("x", 0.2)}, block=block), "e")
    assert np.allclose(got.e, p.groupby("instrument_id").x.transform(lambda v: v.ewm(alpha=0.2, adjust=False).mean()))


def test_affine_scan_keeps_values_over_nulls(spark):
    rows = spark.createDataFrame([("A", t, 0, a, b) for t, (a, b) in enumerate([(None, None), (None, 1.0), (0.5, 2.0), (None, None), (0.5, 1.0)])], KEYS + ", a double, b double")
    assert ordered(scan.affine_scan(rows, {"y": ("a", "b")}, block=2), "y").y.tolist()[1:] == [1.0, 2.5, 2.5, 2.25]
    assert ordered(scan.affine_scan(rows, {"y": ("a", "b")}, block=2), "y").y.isna()[0]


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_merge_asof(history, forward):
    left, right = history.where("seq % 2 = 0"), history.where("seq % 5 = 0").withColumn("v", F.col("x"))
    got = ordered(scan.as_of(left, right, ["v"], forward=forward), "v")
    order = ["event_time_ns", "seq"]
    l, r = (d.toPandas().sort_values(order) for d in (left, right.select("instrument_id", "event_time_ns", "seq", "v")))
    r = r.drop_duplicates(["instrument_id", "event_time_ns"], keep="first" if forward else "last").drop(columns="seq")
    want = pd.merge_asof(l, r, on="event_time_ns", by="instrument_id", direction="forward" if forward else "backward")
    want = want.sort_values(["instrument_id", *order]).reset_index(drop=True)
    assert np.allclose(got.v.fillna(-1), want.v.fillna(-1))


def test_integer_division_of_times(spark):
    t = [1_704_200_174_563_663_999, -1, -DAY, 0, DAY - 1]
    got = spark.createDataFrame([(x,) for x in t], "t long").select("t", idiv("t", 1000).alias("q")).collect()
    assert [r.q for r in got] == [r.t // 1000 for r in got]


def test_no_look_ahead(spark, history):
    """Cutting the future off never changes a feature row."""
    b = bars.time_bars(history.withColumn("price", F.col("x")).withColumn("quantity", F.lit(1.0)), HOUR)
    full = ordered(indicators.macd(b), "macd_signal")
    part = ordered(indicators.macd(b.where(F.col("event_time_ns") < 3 * DAY)), "macd_signal")
    both = full.merge(part, on=["instrument_id", "event_time_ns", "seq"])
    assert len(both) == len(part) and np.allclose(both.macd_signal_x, both.macd_signal_y)


def test_registry_orders_and_refuses():
    r = Registry()
    r.add("a", lambda w: F.col("x"), lookback=2)
    r.add("b", lambda w: F.col("a"), ("a",), 3)
    assert r.levels(["b"]) == [["a"], ["b"]] and r.lookback("b") == 5
    with pytest.raises(ValueError):
        r.add("a", lambda w: F.col("x"))
    r.add("c", lambda w: F.col("d"), ("d",))
    r.add("d", lambda w: F.col("c"), ("c",))
    with pytest.raises(ValueError):
        r.levels(["c"])
    with pytest.raises(KeyError):
        r.levels(["none"])


def test_splits_must_not_overlap():
    with pytest.raises(ValueError):
        labels.split_of("event_time_ns", {"a": ("2024-01-01", "2024-01-05"), "b": ("2024-01-05", "2024-01-09")})


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], KEYS + ", price double, quantity double, side string")
    assert bars.time_bars(empty, HOUR).count() == 0
    assert bars.amount_bars(empty, 5.0).count() == 0
    assert bars.signed_bars(empty, 2.0).count() == 0
    assert joins.concat({"a": empty, "b": empty}).count() == 0
    assert indicators.macd(bars.time_bars(empty, HOUR)).count() == 0


@pytest.fixture(scope="module")
def repeated(spark):
    """Ticks of which some come two or three times, equal in time and number."""
    rows = [("A", k // 2, 0, 100.0 + k // 2 % 5, 1.0 + k % 3 // 2, "BUY" if k // 2 % 3 else "SELL") for k in range(40)] + [("A", 7, 0, 102.0, 2.0, "BUY")] * 3 + [("B", 1, 1, 5.0, 1.0, "BUY")]
    return spark.createDataFrame(rows, KEYS + ", price double, quantity double, side string").repartition(3).cache()


def test_repeated_ticks_count_as_often_as_they_come(repeated):
    total = repeated.groupBy("instrument_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("q")).collect()
    for kind in ("tick", "volume", "value"):
        for runs in (False, True):
            got = bars.signed_bars(repeated, 3.0, kind, runs).groupBy("instrument_id").agg(F.sum("tick_count").alias("n"), F.sum("volume").alias("q")).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, total)), (kind, runs)
    for made in (bars.tick_bars(repeated, 4), bars.amount_bars(repeated, 3.0)):
        assert {r[0]: r[1] for r in made.groupBy("instrument_id").agg(F.sum("volume")).collect()} == pytest.approx({r[0]: r[2] for r in total})


def test_scans_of_repeated_rows(repeated):
    n = repeated.count()
    numbered = scan.numbered(repeated).toPandas()
    assert all(sorted(g.ord_) == list(range(len(g))) for _, g in numbered.groupby("instrument_id"))
    assert scan.prefix(repeated, {"s": F.col("quantity")}).groupBy("instrument_id").agg(F.max("s")).collect()[0][1] is not None
    assert scan.ema(repeated, {"e": ("price", 0.5)}, block=4).count() == n == scan.home(scan.halo(repeated, 3, block=5)).count()

    def places(rows, key):
        for k, (t,) in enumerate(rows):
            yield key, k, t

    got = scan.fold(repeated, places, ["event_time_ns"], "instrument_id string, k long, t long").toPandas()
    assert len(got) == n and all(g.sort_values("k").t.is_monotonic_increasing for _, g in got.groupby("instrument_id"))


def test_affine_maps_run_side_by_side():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000):
        a, b = np.where(rng.random(n) < 0.1, 0, rng.random(n)), rng.normal(size=n)
        y, want = 2.5, []
        for p, q in zip(a, b):
            y = p * y + q
            want.append(y)
        assert np.allclose(scan.affine_run(a, b, 2.5), want)
        p, q = scan.affine_map(a, b)
        assert np.isclose(p * 2.5 + q, want[-1])


@pytest.mark.parametrize("fit", ["fit_logistic", "fit_boosted"])
def test_baselines_learn_a_simple_rule(spark, fit):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    label = np.where(x[:, 0] > 0.4, 1, np.where(x[:, 0] < -0.4, 2, 0))
    rows = spark.createDataFrame([(int(k), float(u), float(v)) for k, (u, v) in zip(label, x)], "label_code int, u double, v double")
    got = getattr(ml, fit)(rows, ["u", "v"])(rows).toPandas()
    assert np.allclose(got.p_notrade + got.p_long + got.p_short, 1) and (got.predicted == got.label_code).mean() > 0.85


def test_late_events_by_policy():
    from marketloom.streaming.streams import step

    events = [(100, 1.0), (200, 2.0), (150, 9.0), (60, 5.0), (210, 3.0)]
    want = {("drop", False): (3, 0, 3), ("log_only", False): (5, 2, 3), ("update_if_not_finalized", False): (4, 1, 4), ("recompute_for_backtest_only", False): (5, 2, 5), ("recompute_for_backtest_only", True): (3, 0, 3)}
    for (policy, live), (rows, late, used) in want.items():
        state, made = None, []
        for t, x in events:
            state, out = step(state, t, x, 0.5, 2, 10, policy, window_ns=100, live=live)
            made += [out] if out else []
        assert (len(made), sum(o[3] for o in made), state[2]) == (rows, late, used), policy


def test_medians_of_any_values(spark):
    """Exact medians of odd and even counts, ties, both signs, huge, tiny and missing values."""
    rng = np.random.default_rng(6)
    of = {
        "a": list(rng.normal(size=501)), "b": list(rng.normal(0, 1e-7, 500)), "c": [1.0] * 70 + [-1.0] * 70, "d": [0.0, -0.0, 1e300, -1e300], "e": [2.5], "f": [None, 4.0, None, 1.0],
        "g": [None], "h": list(rng.integers(-3, 4, 1000).astype(float)), "i": [float("inf"), float("-inf"), 7.0], "j": [-5.0, -4.0], "k": [1.0, float("nan"), float("nan")],
    }
    rows = [(k, None if x is None else float(x)) for k, xs in of.items() for x in xs]
    got = {r.k: r.m for r in scan.medians(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", "m").collect()}
    assert set(got) == set(of) and got["g"] is None and np.isnan(got["k"])
    for k in of.keys() - {"g", "k"}:
        assert np.isclose(got[k], np.median([x for x in of[k] if x is not None]), rtol=1e-12, atol=0), k


def test_first_rows_of_ties(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 2).alias("v")).repartition(7)
    for n in (0, 1, 1700, 2500, 4000, 9000):
        got = {r.id for r in scan.first_rows(rows, [F.desc("v"), F.col("id")], n).collect()}
        assert got == set(([*range(1, 5000, 2)] + [*range(0, 5000, 2)])[:n])
    assert scan.first_rows(rows.where("false"), [F.col("id")], 3).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k in "ab" for v in [None, 0.0, -1.5, 3.0, 3.0, 1e12, *rng.normal(size=301).tolist(), *rng.integers(0, 5, 50).astype(float).tolist()]] + [("c", None), ("d", 2.0)]
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p333": 1 / 3, "p99": 0.99, "p100": 1.0}
    got = {r.k: [r[c] for c in points] for r in scan.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points).collect()}
    want = [np.quantile([v for k, v in rows if k == "a" and v is not None], q) for q in points.values()]
    assert got["a"] == pytest.approx(want) and got["c"] == [None] * 6 and got["d"] == [2.0] * 6


def test_no_trade_rows_are_no_signals(spark):
    """A side above the threshold counts only where it is the likeliest class."""
    from marketloom.operators import ml

    rows = [(1, 0, 1, 0.45, 0.44, 0.11, 0.5), (2, 1, 1, 0.1, 0.6, 0.3, 0.5), (3, 2, 1, 0.2, 0.2, 0.6, 0.5), (4, 0, 0, 0.3, 0.35, 0.35, -0.5)]
    df = spark.createDataFrame(rows, "row_id int, y int, event_time_ns long, p_notrade double, p_long double, p_short double, future_return double").withColumn("predicted", ml.likeliest())
    got = {r.kind: r for r in ml.thresholds(df, [0.4, 0.99], 0.1, 0.2).where("threshold = 0.4").collect()}
    assert [r.predicted for r in df.orderBy("row_id").collect()] == [0, 1, 2, 2]
    assert (got["long"].signals, got["short"].signals, got["both"].signals) == (1, 1, 2) and got["both"].precision == 1.0 and got["both"].per_day == 2.0
    assert got["short"].avg_return == -0.5 and got["both"].median_return == 0.0 and got["both"].positive_rate == 0.5
    assert ml.thresholds(df, [0.99], 0.1, 0.2).where("signals > 0 or precision is not null").count() == 0
    assert [r.row_id for r in ml.top_share(df, 0.5).orderBy("row_id").collect()] == [2, 3]
    assert ml.top_share(df, 1.0).count() == 3
