"""Bars of state machines: blocks side by side give what one pass gives."""

import random

import pytest

from marketloom.operators import bars, scan

KIND = "instrument_id string, event_time_ns long, seq long, price double, quantity double, side string"


def ticks(n=600, seed=1, sides=("BUY", "SELL", "BUY", None)):
    draw = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        price += draw.gauss(0, 1)
        rows.append((f"I{i % 7 // 6}", 10 * (i // 2), i, price, draw.choice((1.0, 2.5, None, 0.5)), draw.choice(sides)))
    return rows


def signed(rows, step, kind, runs):
    """Ticks of each bar, by one pass."""
    out, held, bar = {}, {}, {}
    for name, _, seq, price, quantity, side in rows:
        weight = {"tick": 1.0, "volume": quantity, "value": None if quantity is None else price * quantity}[kind] or 0.0
        x = weight * {"BUY": 1.0, "SELL": -1.0}.get(side, 0.0)
        h = held.get(name, 0.0)
        if runs and h * x < 0:
            h = 0.0
        h += x
        out.setdefault((name, bar.setdefault(name, 0)), []).append(seq)
        if abs(h) >= step:
            bar[name], h = bar[name] + 1, 0.0
        held[name] = h
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize(("kind", "step", "runs", "how"), [
    ("tick", 4.0, False, {"block": 13, "warm": 0}), ("volume", 5.0, True, {"block": 50, "warm": 20}), ("value", 400.0, False, {"block": 37, "warm": 5}), ("tick", 3.0, True, {}), ("volume", 1e9, False, {"block": 40, "warm": 8, "rounds": 2}),
])
def test_signed_bars(spark, kind, step, runs, how):
    rows = ticks()
    got = bars.signed_bars(spark.createDataFrame(rows, KIND).repartition(3), step, kind, runs, **how).collect()
    assert {(r.instrument_id, r.bar): r.tick_count for r in got} == signed(rows, step, kind, runs)


@pytest.mark.parametrize("how", [{"block": 11, "warm": 0}, {"block": 64, "warm": 16}, {"block": 9, "warm": 2, "rounds": 1}, {}])
def test_renko(spark, how):
    rows = ticks(seed=4)
    want, base, at, n = [], {}, {}, {}
    for name, t, _, price, *_ in rows:
        first = base.setdefault(name, price)
        k = at.setdefault(name, 0)
        while abs(price - (first + k * 1.7)) >= 1.7 - 1e-9:
            new = k + (1 if price > first + k * 1.7 else -1)
            want.append((name, n.setdefault(name, 0), t, round(first + k * 1.7, 6), round(first + new * 1.7, 6), new - k))
            k, n[name] = new, n[name] + 1
        at[name] = k
    got = bars.renko(spark.createDataFrame(rows, KIND).repartition(3), 1.7, **how).collect()
    assert sorted((r.instrument_id, r.brick, r.event_time_ns, round(r.open, 6), round(r.close, 6), r.direction) for r in got) == sorted(want)


def test_one_hot_instrument_uses_many_tasks(spark):
    rows = spark.createDataFrame([("A", i, i, 100.0, 1.0, "BUY" if i * 7919 % 13 < 7 else "SELL") for i in range(5000)], KIND)
    made = scan.speculate(rows, lambda c, s: (0.0, 0, {"x_": c["seq"]}), lambda c: 0.0, ["seq"], "x_ long", block=100, warm=10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = made.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 5000 and sum(n > 0 for n in sizes) > 1
    assert bars.renko(rows.where("false"), 1.0).count() == 0
