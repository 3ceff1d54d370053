"""Results that must not depend on the order in which doubles are summed or multiplied."""

import duckdb
import pytest

from marketloom.operators import bars, stats
from marketloom.plans import registry
from marketloom.schemas import DAY


def test_amount_bars_count_amounts_exactly(spark):
    """Ten tenths fill a bar of one; as doubles they leave a rest, which split the eleventh tick."""
    ticks = spark.createDataFrame([("A", k, k, 2.0, 0.1) for k in range(30)], "instrument_id string, event_time_ns long, seq long, price double, quantity double")
    for step, notional in ((1.0, False), (2.0, True)):
        got = sorted((r.bar, r.tick_count, round(r.volume, 9)) for r in bars.amount_bars(ticks, step, notional).collect())
        assert got == [(0, 10, 1.0), (1, 10, 1.0), (2, 10, 1.0)]


def test_growth_and_drawdown_multiply_days_in_order(spark):
    """Large products show their last digits: sums of logarithms lost three of them."""
    rets = [(200 + k * 37 % 100) / 100 if k % 3 else -0.5 for k in range(400)]
    total, peak, fall = 1.0, 1.0, 0.0
    for x in rets:
        total *= 1 + x
        peak = max(peak, total)
        fall = max(fall, (peak - total) / peak)
    parts = [("A", k * DAY + j, p) for k, x in enumerate(rets) for j, p in enumerate((x + 0.1, 0.2, -0.3))]  # 0.1 + 0.2 - 0.3 is no zero in doubles
    df = spark.createDataFrame(parts, "run_uid string, event_time_ns long, ret double").repartition(7)
    cagr = total ** (252 / len(rets)) - 1
    assert stats.return_stats(df).first().cagr == pytest.approx(cagr, rel=1e-15, abs=0)
    assert stats.max_drawdown(df).first().max_drawdown == pytest.approx(-fall, rel=1e-15, abs=0)
    assert stats.calmar(df).first().calmar == pytest.approx(cagr / fall, rel=2e-15, abs=0)
    assert [r.net for r in stats.daily_bins(df).orderBy("day").collect()] == rets


def test_returns_too_large_to_count_are_summed(spark):
    df = spark.createDataFrame([("A", 0, 1e30), ("A", 1, 2.0), ("A", DAY, None), ("A", 2 * DAY, 0.5)], "run_uid string, event_time_ns long, ret double")
    assert [r.net for r in stats.daily_bins(df).orderBy("day").collect()] == [1e30, None, 0.5]


def test_drawdown_of_a_growth_beyond_doubles(spark):
    """Growth of A exceeds a double of either sign and turns back; that of B falls without end."""
    rets = [("A", k * DAY, -24.0) for k in range(400)] + [("A", 400 * DAY, -0.5), ("A", 401 * DAY, -61.0)] + [("B", k * DAY, -3.0 if k == 0 else 9.0) for k in range(400)]
    rets += [("C", 0, None), ("D", 0, 0.5), ("D", DAY, float("nan"))]
    df = spark.createDataFrame(rets, "run_uid string, event_time_ns long, ret double").repartition(5)
    got = {r.run_uid: r.max_drawdown for r in stats.max_drawdown(df).collect()}
    assert got["A"] == -31.0 and got["B"] == float("-inf") and got["C"] == 0.0 and got["D"] != got["D"]


def test_drawdown_after_a_day_that_loses_all(spark, tmp_path):
    """Ten times a tenth lost leaves nothing of AF; as doubles it leaves a rest, which grew again in the SQL."""
    c = duckdb.connect()
    c.execute("""create table lineitem as select row_number() over () as l_orderkey, 1 as l_linenumber, 1.0::double as l_quantity, 10.0::double as l_extendedprice, d::double as l_discount, 0.0::double as l_tax,
      f as l_returnflag, s as l_linestatus, timestamp '2024-01-01' + to_days(k::int) as l_shipdate from (
      select 0 as k, 0.1 as d, 'A' as f, 'F' as s from range(10) union all select range + 1, 3.0, 'A', 'F' from range(60) union all select range, 24.0, 'R', 'O' from range(400))""")
    c.execute("create table orders as select l_orderkey as o_orderkey, timestamp '2023-12-01' as o_orderdate from lineitem")
    for t in ("lineitem", "orders"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = {n: sorted(map(tuple, registry.queries()[n](spark, str(tmp_path)).collect())) for n in ("stat_max_drawdown", "stat_calmar")}
    assert got["stat_max_drawdown"] == [("AF", -1.0), ("RO", -24.0)]
    for name, rows in got.items():
        assert sorted(c.execute(registry.oracle_sql()[name]).fetchall()) == rows
