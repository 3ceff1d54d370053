"""Files at rest: manifests of real files, reads that open only what a time range needs, archives
by batch, and compaction to a target size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators import scan
from marketloom.schemas import KEY

#: Bytes of a file that compaction aims at.
TARGET = 128 << 20


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each Parquet file under root: path, bytes, row_count, and the times it spans."""
    rows = spark.read.parquet(root)
    at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    return rows.groupBy(*at).agg(F.count("*").alias("row_count"), F.min("event_time_ns").alias("start_ts"), F.max("event_time_ns").alias("end_ts"))


def read_range(spark: SparkSession, root: str, manifest: DataFrame, start: int, end: int) -> DataFrame:
    """Rows under root in an inclusive time range; only files whose span meets it are opened.
    The paths of these files (and no rows) come to the driver, which plans their read anyway."""
    hit = manifest.where((F.col("start_ts") <= end) & (F.col("end_ts") >= start)).select("path").collect()
    if not hit:
        return spark.read.parquet(root).limit(0)
    rows = spark.read.option("basePath", root).parquet(*sorted(r["path"] for r in hit))
    return rows.where(F.col("event_time_ns").between(start, end))


def write_groups(df: DataFrame, root: str, groups: dict[str, list[str]], partition: list[str], batch: int | None = None) -> DataFrame:
    """Write each group's columns to a folder of its name (and of the batch's number), what feeds
    them computed once, then the manifest of the files that are there, last: what has no manifest
    doesn't count as written. Writing again replaces all of it. Returns the manifest with `group`."""
    spark, keys, inner = df.sparkSession, [KEY, "event_time_ns", *partition], "" if batch is None else f"/batch={batch}"
    df = scan.settled(df.select(*dict.fromkeys([*keys, *(c for columns in groups.values() for c in columns)])))
    found = []
    for name, columns in groups.items():
        part = df.select(*dict.fromkeys([*keys, *columns]))
        part.repartition(*partition).write.partitionBy(*partition).mode("overwrite").parquet(f"{root}/{name}{inner}")
        found.append(file_manifest(spark, f"{root}/{name}{inner}").withColumn("group", F.lit(name)))
    reduce(DataFrame.unionByName, found).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest{inner}")  # a row for each file
    return spark.read.parquet(f"{root}/manifest{inner}")


def archive_stream(stream: DataFrame, root: str, groups: dict[str, list[str]], partition: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Archive a stream over all that is there: each micro-batch, after `prepare`, goes to
    folders of its number as in `write_groups`, so that a replay replaces it and changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        write_groups(prepare(rows), root, groups, partition, number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_archive(spark: SparkSession, root: str, group: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A group's rows of all finished batches, from the files that their manifests name."""
    manifest = spark.read.parquet(f"{root}/manifest").where(F.col("group") == group)
    low, high = -(1 << 63) if start is None else start, (1 << 63) - 1 if end is None else end
    return read_range(spark, f"{root}/{group}", manifest, low, high)


def compaction_plan(files: DataFrame, keys: list[str], target: int = TARGET) -> DataFrame:
    """files (path, bytes, keys) with `bin`: which files of a partition become one, by best fit of
    the largest first into bins of `target` bytes, and `parts`: how many files a bin makes (more
    than one only for a file above the target)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "path"], ascending=[False, True]).reset_index(drop=True)
        room: list[int] = []
        bins = []
        for size in rows["bytes"].tolist():
            fits = [(r, k) for k, r in enumerate(room) if r >= size]
            k = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(max(target, size))
            room[k] -= size
            bins.append(k)
        return rows.assign(bin=bins, parts=[max(1, -(-size // target)) for size in rows["bytes"].tolist()])

    return files.groupBy(*keys).applyInPandas(pack, f"{kinds}, bin int, parts int")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Path and bytes of the Parquet files under a folder, from listings alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", F.col("length").alias("bytes"))


def compact(spark: SparkSession, path: str, out: str, target: int = TARGET) -> DataFrame:
    """Write the rows under path to out as files of about `target` bytes, and return the plan.

    Files are sized by their listing; each task writes one bin, so no task and no file holds more
    than about the target, however large the folder is. Partition columns under path stay.
    """
    root = F.regexp_replace("path", "/[^/]+$", "")
    plan = scan.settled(compaction_plan(listed(spark, path).withColumn("folder", root), ["folder"], target))
    line = Window.partitionBy(F.lit(0)).orderBy("folder", "bin")
    bins = plan.groupBy("folder", "bin").agg(F.max("parts").alias("parts"))
    bins = bins.withColumn("number_", F.sum("parts").over(line) - F.col("parts"))  # a row for each file to write
    total = bins.agg(F.sum("parts")).first()[0] or 1
    tail = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  listings and metadata write schemes apart
    where = plan.select(tail(F.col("path")).alias("path_"), "folder", "bin").join(bins, ["folder", "bin"]).select("path_", "number_", F.col("parts").alias("parts_"))
    rows = spark.read.parquet(path)
    keys = [c for c in _partitions(spark, path) if c in rows.columns]
    numbered = rows.withColumn("path_", tail(F.col("_metadata.file_path"))).join(where, "path_").drop("path_")
    place = F.col("number_") + F.pmod(F.monotonically_increasing_id(), F.col("parts_"))
    dealt = numbered.repartitionById(int(total), place.cast("int")).drop("number_", "parts_")
    (dealt.write.partitionBy(*keys) if keys else dealt.write).mode("overwrite").parquet(out)
    return plan


def _partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders' partition columns."""
    first = listed(spark, path).select("path").first()
    return [] if first is None else [p.split("=")[0] for p in first["path"].removeprefix(path).split("/") if "=" in p]


def replace(spark: SparkSession, path: str, new: str) -> None:
    """Put the folder `new` in the place of `path`: two renames, so a reader sees the old rows, for
    a moment none, or the new ones, and never both. After a crash between them the old rows are in
    `<path>.old`. On stores that copy to rename, publish the new folder's name instead."""
    jvm = spark._jvm.org.apache.hadoop.fs
    old, now, kept = jvm.Path(path), jvm.Path(new), jvm.Path(path.rstrip("/") + ".old")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(old, kept) or not files.rename(now, old):
        raise OSError(f"{new} could not take the place of {path}")
    files.delete(kept, True)
