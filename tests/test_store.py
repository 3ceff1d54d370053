"""Files at rest: what is opened, what a replay changes, and how large compacted files are."""

import os

from pyspark.sql import functions as F

from marketloom.sources import store

KIND = "instrument_id string, event_time_ns long, x double, day int"


def rows(spark, n=400):
    return spark.createDataFrame([(f"I{i % 3}", i, float(i), i // 100) for i in range(n)], KIND)


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_range_opens_only_files_that_meet_it(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    rows(spark).repartitionByRange(8, "event_time_ns").write.partitionBy("day").parquet(root)
    manifest = store.file_manifest(spark, root)
    got = store.read_range(spark, root, manifest, 120, 130)
    assert len(got.inputFiles()) < 3 < len(files_of(tmp_path / "a"))
    assert sorted(r.event_time_ns for r in got.collect()) == list(range(120, 131)) and set(got.columns) == {"instrument_id", "event_time_ns", "x", "day"}
    assert store.read_range(spark, root, manifest, 900, 950).count() == 0
    assert sum(r.row_count for r in manifest.collect()) == 400


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, root = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    df = rows(spark)
    for half in ("day < 2", "day >= 2"):
        df.where(half).coalesce(1).write.mode("append").parquet(source)
    groups = {"raw": ["x"], "twice": ["y"]}
    twice = lambda r: r.withColumn("y", F.col("x") * 2)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.archive_stream(stream(), root, groups, ["day"], f"file://{tmp_path}/check", twice)
    want = sorted(map(tuple, twice(df).select("instrument_id", "event_time_ns", "y", "day").collect()))
    read = lambda: sorted(map(tuple, store.read_archive(spark, root, "twice").select("instrument_id", "event_time_ns", "y", "day").collect()))
    assert read() == want
    store.write_groups(twice(df.where("day >= 2")), root, groups, ["day"], 1)  # again
    assert read() == want
    os.rename(tmp_path / "out/manifest/batch=1", tmp_path / "gone")  # a batch that was never finished
    assert read() == [r for r in want if r[3] < 2]


def test_compaction_by_size(spark, tmp_path):
    path, out = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    df = spark.range(60_000).select(F.concat(F.lit("I"), F.col("id") % 3).alias("instrument_id"), F.col("id").alias("event_time_ns"), F.rand(1).alias("x"), (F.col("id") % 2).cast("int").alias("day"))
    df.repartition(24).write.partitionBy("day").parquet(path)
    before = files_of(tmp_path / "a")
    target = 4 * max(map(os.path.getsize, before))
    plan = store.compact(spark, path, out, target)
    sizes = {k: v for k, v in plan.groupBy("folder", "bin").agg(F.sum("bytes").alias("b")).select(F.concat_ws("#", "folder", "bin"), "b").collect()}
    after = files_of(tmp_path / "b")
    assert max(sizes.values()) <= target and len(after) == len(sizes) < len(before) / 3
    assert max(map(os.path.getsize, after)) < 1.2 * target
    assert spark.read.parquet(out).exceptAll(spark.read.parquet(path)).count() == 0 == spark.read.parquet(path).exceptAll(spark.read.parquet(out)).count()
    big = store.compaction_plan(spark.createDataFrame([("p", 10, "f"), ("q", 35, "f"), ("r", 6, "f"), ("s", 4, "g")], "path string, bytes long, folder string"), ["folder"], 16).collect()
    assert {(r.path, r.bin, r.parts) for r in big} == {("q", 0, 3), ("p", 1, 1), ("r", 1, 1), ("s", 0, 1)}
    store.replace(spark, path, out)
    assert files_of(tmp_path / "a") and not os.path.exists(tmp_path / "b") and spark.read.parquet(path).count() == 60_000


def test_gaps_of_overlapping_intervals(spark):
    import random

    from marketloom.sources import catalog

    draw = random.Random(3)
    stored = [(f"I{draw.randint(0, 3)}", a := draw.randint(0, 900), a + draw.randint(0, 30)) for _ in range(40)] + [("I9", 5000, 5001)]
    want = []
    for k in sorted({r[0] for r in stored}):
        held, begun = {t for n, a, b in stored if n == k for t in range(a, b + 1)}, None
        for t in range(100, 802):
            if t <= 800 and t not in held:
                begun = t if begun is None else begun
            elif begun is not None:
                want.append((k, begun, t - 1))
                begun = None
    got = catalog.missing_intervals(spark.createDataFrame(stored, "instrument_id string, start_ns long, end_ns long"), 100, 800)
    assert sorted(map(tuple, got.collect())) == sorted(want)
