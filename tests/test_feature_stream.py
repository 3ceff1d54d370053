"""Registered features as a stream: any chunking, late rows, restarts and other versions."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions.features import Registry
from marketloom.operators import rolling  # noqa: F401  (registers features)
from marketloom.functions.features import REGISTRY
from marketloom.streaming.feature_stream import FeatureStream, differences, signature

NAMES = ["feat_sma_20", "zscore", "atr", "breakout_up", "derived_rolling_std", "feat_vwm_zscore_60", "ewma_12", "ewma_signal", "ewma_swing", "ewma_gap"]
KIND = "instrument_id string, event_time_ns long, seq long, open double, high double, low double, close double, volume double"


def rows(n=400, seed=3):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        close = 100 + draw.gauss(0, 1)
        out.append((f"I{i % 3 if i % 7 else 5}", 10 * i, i, close, close + 1, close - 1, None if i % 50 == 49 else close, 5.0 + i % 9))
    return out


def batch(spark, data, names=NAMES, registry=REGISTRY):
    return registry.compute(spark.createDataFrame(data, KIND), names, block=37)


def fed(spark, stream, chunks):
    for k, part in enumerate(chunks):
        stream.write(spark.createDataFrame(part, KIND), k)


def check(spark, got, want, names=NAMES):
    for r in differences(got, want, names).collect():
        assert r.different == 0, r


def test_any_chunking_equals_the_batch(spark, tmp_path):
    data = rows()
    draw = random.Random(1)
    cuts = sorted(draw.sample(range(len(data)), 4))
    stream = FeatureStream(NAMES, f"file://{tmp_path}/a")
    fed(spark, stream, [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])])
    got = stream.read(spark, spark.createDataFrame([], KIND).schema)
    assert got.count() == len(data)
    check(spark, got, batch(spark, data))


def test_rows_out_of_order_within_the_lateness(spark, tmp_path):
    data = rows(240)
    draw = random.Random(2)
    mixed = sorted(data, key=lambda r: r[1] + draw.uniform(0, 200))
    stream = FeatureStream(NAMES, f"file://{tmp_path}/a", lateness_ns=300)
    fed(spark, stream, [mixed[:90], mixed[90:91], mixed[91:200], mixed[200:]])
    kind = spark.createDataFrame([], KIND).schema
    assert stream.read(spark, kind, "late").count() == 0
    done, left = stream.read(spark, kind), stream.waiting(spark, kind)
    assert left.count() > 0
    check(spark, done.unionByName(left), batch(spark, data))


def test_late_rows_change_nothing(spark, tmp_path):
    data = rows(120)
    late = [(r[0], r[1] - 500, 1000 + r[2], *r[3:]) for r in data[60:70]]
    stream = FeatureStream(NAMES, f"file://{tmp_path}/a")
    fed(spark, stream, [data[:80], late + data[80:]])
    kind = spark.createDataFrame([], KIND).schema
    assert sorted(r.seq for r in stream.read(spark, kind, "late").collect()) == sorted(r[2] for r in late)
    check(spark, stream.read(spark, kind), batch(spark, data))


def test_stop_restart_and_replay(spark, tmp_path):
    """A second run goes on where the first stopped, and doing a micro-batch again changes nothing."""
    data, source, root = rows(200), f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    kind = spark.createDataFrame([], KIND).schema
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (data[:70], data[70:150]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
    FeatureStream(NAMES, root).run(read(), f"file://{tmp_path}/checkpoint")
    spark.createDataFrame(data[150:], KIND).coalesce(1).write.mode("append").parquet(source)
    again = FeatureStream(NAMES, root)
    again.run(read(), f"file://{tmp_path}/checkpoint")
    check(spark, again.read(spark, kind), batch(spark, data))
    again.write(spark.createDataFrame(data[150:], KIND), again.last(spark))
    check(spark, again.read(spark, kind), batch(spark, data))
    with pytest.raises(ValueError, match="other features"):
        FeatureStream(NAMES[:-1], root).run(read(), f"file://{tmp_path}/other")


def test_versions_and_user_features(spark, tmp_path):
    def registry(version):
        own = Registry()
        own.add("double", lambda w: F.col("close") * 2, inputs=("close",), version=version)
        own.add("gain", lambda w: F.col("double") - w.lag("double", 3), ("double",), 3)
        own.add_recursion("total", lambda w: F.lit(1.0), lambda w: F.col("gain"), deps=("gain",))
        own.add("calm", lambda w: F.avg("total").over(w.rows(4)), ("total",), 3)
        return own

    one, two = registry(1), registry(2)
    assert signature(one, ["calm"]) != signature(two, ["calm"]) and one.stages(["calm"]) == [[["double"], ["gain"]], [["total"]], [["calm"]]]
    data, names = rows(90), ["calm", "gain"]
    stream = FeatureStream(names, f"file://{tmp_path}/a", registry=one)
    stream.claim(spark)
    fed(spark, stream, [data[:31], data[31:32], [], data[32:]])
    check(spark, stream.read(spark, spark.createDataFrame([], KIND).schema), batch(spark, data, names, one), names)
    with pytest.raises(ValueError, match="versions"):
        FeatureStream(names, f"file://{tmp_path}/a", registry=two).claim(spark)


def test_grouped_functions_in_blocks_and_streams(spark, tmp_path):
    """A user's function of arrays gives the same in any block, and as a stream."""
    import numpy as np

    own = Registry()
    own.add_grouped("spread", lambda c: np.array([np.nan if k < 3 else np.ptp(c["high"][k - 3 : k + 1]) for k in range(len(c["high"]))]), 3, ("high",))
    own.add("calm", lambda w: F.avg("spread").over(w.rows(5)), ("spread",), 4)
    data = rows(150)
    whole = own.compute(spark.createDataFrame(data, KIND), ["spread", "calm"])
    check(spark, own.compute(spark.createDataFrame(data, KIND), ["spread", "calm"], block=7), whole, ["spread", "calm"])
    stream = FeatureStream(["spread", "calm"], f"file://{tmp_path}/a", registry=own)
    fed(spark, stream, [data[:50], data[50:53], data[53:]])
    check(spark, stream.read(spark, spark.createDataFrame([], KIND).schema), whole, ["spread", "calm"])
