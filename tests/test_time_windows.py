"""Windows of time: as one pass would sum them, in work that doesn't grow with their rows."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import rolling
from marketloom.plans import registry
from tests.oracle import DATA, connect

SPAN = 100
SCHEMA = "instrument_id string, event_time_ns long, seq long, x double"


def windows(spark, rows):
    made = {"n": ("count", F.lit(1)), "k": ("count", F.col("x")), "total": ("sum", F.col("x")), "mean": ("avg", F.col("x"))}
    return rolling.in_time(spark.createDataFrame(rows, SCHEMA).repartition(5), SPAN, made).orderBy("seq").collect()


def plain(rows, i):
    key, t = rows[i][:2]
    inside = [r[3] for r in rows if r[0] == key and (r[1] is None if t is None else r[1] is not None and t - SPAN < r[1] <= t)]
    return len(inside), [x for x in inside if x is not None]


def test_odd_values_and_times_as_one_pass(spark):
    """Ties, edges of windows, times below zero or missing, keys missing, and values that no decimal holds."""
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf"), -float("inf"), 1e300, -1e17, 1e-15, 0.0, -0.0, 1 / 3]
    times = [*map(int, rng.integers(-500, 500, 300)), *range(-300, 301, 50), *[7] * 20, *[None] * 4]
    rows = [(("A", "B", None)[k % 3], t, k, odd[k // 7 % len(odd)] if k % 7 == 0 else int(rng.integers(0, 10**6)) / 100) for k, t in enumerate(times)]
    got = windows(spark, rows)
    assert [r.seq for r in got] == list(range(len(rows)))
    for k, r in enumerate(got):
        n, some = plain(rows, k)
        assert (r.n, r.k) == (n, len(some))
        if not some:
            assert r.total is None and r.mean is None
            continue
        finite = all(map(math.isfinite, some))
        total = float(sum(map(Fraction, some))) if finite else sum(some)
        assert r.total == pytest.approx(total, rel=1e-12, abs=1e-9, nan_ok=True)
        assert r.mean == pytest.approx(total / len(some), rel=1e-12, abs=1e-9, nan_ok=True)


def test_totals_do_not_depend_on_the_order_of_summing(spark):
    """Ten tenths are one; as doubles they left a rest, which rounded half-way means at random."""
    rows = [("A", 10 * k, k, 0.1) for k in range(40)]
    got = windows(spark, rows)[9:]
    assert {(r.n, r.total, r.mean) for r in got} == {(10, 1.0, 0.1)} and len(got) == 31


def test_half_way_means_are_those_of_decimals(spark):
    """Means of cents over 64 rows that end in a five in the seventh place, each the nearest double."""
    rows = [("A", 200 * k + j, 64 * k + j, (12345 + 97 * k + (j < 2 + 4 * k)) / 100) for k in range(40) for j in range(64)]
    for r in windows(spark, rows):
        want = Fraction(sum(round(x[3] * 100) for x in rows[r.seq - r.seq % 64 : r.seq + 1]), 100 * r.n)
        assert abs(Fraction(r.mean) - want) <= Fraction(want) / 2**52
        if r.n == 64:
            assert r.mean == float(want)


def test_small_values_keep_their_digits(spark):
    rows = [("A", k, k, x) for k, x in enumerate((1.23456789e-14, 2.5e-20))]
    assert [r.total for r in windows(spark, rows)] == [1.23456789e-14, 1.23456789e-14 + 2.5e-20]


@pytest.mark.parametrize("name", ["rolling_time_window", "trade_count", "trade_intensity"])
def test_no_frame_slides(spark, name):
    """Spark sums a frame that slides anew for each row: rows times rows of a dense hour."""
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_a_dense_hour(spark, tmp_path):
    """All trades at distinct times of two hours: the query's rows are its SQL's, but for half-way means."""
    c = connect()
    c.execute(f"copy (select event_id, timestamp '2024-01-01' + to_microseconds(event_id * 7200000) as ts, user_id // 100 * 8 as user_id, event_type, value, props from events) to '{tmp_path}/events.parquet' (format parquet)")
    got = {r.seq: r for r in registry.queries()["rolling_time_window"](spark, str(tmp_path)).collect()}
    c.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(registry.oracle_sql()["rolling_time_window"]).df()
    assert len(got) == len(want) > 900 and want.n.max() == 500
    for w in want.itertuples():
        r = got[w.seq]
        assert (r.n, r.total) == (w.n, w.total) and abs(r.mean - w.mean) < 1.1e-6
