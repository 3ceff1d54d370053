"""Registered features over a stream: the batch expressions on what each instrument still needs.

The state of an instrument is its last rows, as many as the features' windows reach back, with
the values of their recursions, and the rows that are not yet final. A micro-batch reads the
state, adds its rows, computes the registry's own window expressions and one affine run for each
recursion, and writes output and next state together. All of it needs one shuffle, by instrument.

Everything that a micro-batch writes goes to a folder of its number in one job, from the state of
the number before. A replay overwrites the folder with the same rows, so a stop or a lost executor
at any point loses and repeats nothing. The folder of a stream bears the digest of its features'
names, versions and dependencies; another set or version is refused.

An instrument's rows are final once `lateness_ns` older than its newest row, so rows may come out
of order by that much; a slow instrument isn't made late by a fast one. A row older than one that
is final already is late: it changes nothing and is kept apart.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.features import REGISTRY, Recursion, Registry
from marketloom.operators.scan import affine_run
from marketloom.schemas import KEY, ORDER


def signature(registry: Registry, names: list[str]) -> str:
    """Digest of the features and of all that they build on: names, versions, dependencies,
    lookbacks and inputs."""
    known = [registry.known[n] for level in registry.levels(names) for n in level]
    return hashlib.sha256(json.dumps([sorted(names), sorted((f.name, f.version, list(f.deps), f.lookback, list(f.inputs), isinstance(f, Recursion)) for f in known)]).encode()).hexdigest()


def _solve(table: pa.Table, names: list[str]) -> pa.Table:
    """Recursions of one instrument's rows: rows of the state have their values already."""
    table = table.sort_by([(c, "ascending") for c in ORDER])
    old = table.column("old_").to_numpy(zero_copy_only=False)
    for n in names:
        a, b, start, y = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (f"{n}_a0", f"{n}_b0", f"{n}_s0", n))
        null = np.where(old, table.column(n).is_null().to_numpy(zero_copy_only=False), table.column(f"{n}_b0").is_null().to_numpy(zero_copy_only=False))
        a, b = np.where(null, 1.0, np.where(old, 0.0, a)), np.where(null, 0.0, np.where(old, y, b))
        known = np.flatnonzero(~null)
        if len(known) and not old[known[0]]:
            a[known[0]], b[known[0]] = 0.0, start[known[0]]
        seen = np.maximum.accumulate(~null) if len(null) else null
        table = table.set_column(table.schema.get_field_index(n), n, pa.array(affine_run(a, b, 0.0), mask=~seen))
    return table.drop_columns([f"{n}_{x}0" for n in names for x in "abs"])


def _solver(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _solve(table, names)


class FeatureStream:
    """A set of registered features over a stream of rows (instrument_id, event_time_ns, seq and
    the features' inputs).

    root: the folder of output and state, which executors share. Ties of (event_time_ns, seq) of
    one instrument have no defined order.
    """

    def __init__(self, names: list[str], root: str, lateness_ns: int = 0, registry: Registry = REGISTRY):
        self.registry, self.names, self.root, self.lateness_ns = registry, list(names), root.rstrip("/"), lateness_ns
        self.stages = registry.stages(names)
        self.recursions = [n for k, stage in enumerate(self.stages) if k % 2 for level in stage for n in level]
        self.tail = max([registry.lookback(n) for stage in self.stages for level in stage for n in level] + [1 if self.recursions else 0])

    def claim(self, spark: SparkSession) -> None:
        """Mark the folder as this set's, or refuse it if it is another's."""
        own, path = signature(self.registry, self.names), f"{self.root}/signature"
        try:
            found = spark.read.schema("signature string, features string").json(path).first()["signature"]
        except AnalysisException:
            spark.createDataFrame([(own, ",".join(self.names))], "signature string, features string").coalesce(1).write.json(path)
            return
        if found != own:
            raise ValueError(f"{self.root} holds the state of other features or versions")

    def folder(self, number: int) -> str:
        return f"{self.root}/batches/batch={number}"

    def _state(self, spark: SparkSession, number: int, columns: T.StructType) -> DataFrame:
        state = T.StructType([*columns.fields, *(T.StructField(n, T.DoubleType()) for n in self.recursions), T.StructField("old_", T.BooleanType())])
        if number < 0:
            return spark.createDataFrame([], state)
        return spark.read.schema(T.StructType([*state.fields, T.StructField("part_", T.StringType())])).parquet(self.folder(number)).where("part_ = 'state'").drop("part_")

    def step(self, rows: DataFrame, number: int, lateness_ns: int | None) -> DataFrame:
        """Output, state and late rows of one micro-batch, told apart by `part_`. Without a
        lateness all rows are final."""
        none = [F.lit(None).cast("double").alias(n) for n in self.recursions]
        new = rows.select(*rows.columns, *none, F.lit(False).alias("old_"), F.lit(True).alias("new_"))
        both = self._state(rows.sparkSession, number - 1, rows.schema).withColumn("new_", F.lit(False)).unionByName(new)
        mine = Window.partitionBy(KEY)
        at = F.struct(*ORDER)
        # newest row and newest final row so far of each instrument, without an ordering
        both = both.withColumns({"high_": F.max("event_time_ns").over(mine), "done_": F.max(F.when(F.col("old_"), at)).over(mine)})
        late = F.coalesce(F.col("new_") & (at <= F.col("done_")), F.lit(False))
        final = F.lit(True) if lateness_ns is None else F.col("event_time_ns") <= F.col("high_") - lateness_ns
        kind = F.when(late, "late").when(F.col("old_"), "old").when(final, "final").otherwise("waits")
        both = both.withColumn("kind_", kind).drop("high_", "done_", "new_")
        # only rows of one kind stand in a window with others, so late and waiting rows don't count
        both = both.withColumn("line_", F.when(F.col("kind_").isin("old", "final"), 0).when(F.col("kind_") == "waits", 1).otherwise(2))
        out = both
        for k, levels in enumerate(self.stages):
            out = self.registry.windows(out, levels, "line_")
            if k % 2:
                made = [n for level in levels for n in level]
                schema = T.StructType([f for f in out.schema.fields if f.name not in {f"{n}_{x}0" for n in made for x in "abs"}])
                out = out.groupBy(KEY, "line_").applyInArrow(_solver(made), schema)
        back = F.row_number().over(Window.partitionBy(KEY, "line_").orderBy(*(F.desc(c) for c in ORDER)))
        out = out.withColumn("back_", back)
        keeps = ((F.col("line_") == 0) & (F.col("back_") <= max(self.tail, 1))) | (F.col("kind_") == "waits")
        parts = F.filter(F.array(F.when(F.col("kind_") == "final", "out"), F.when(keeps, "state"), F.when(F.col("kind_") == "late", "late")), lambda x: x.isNotNull())
        picked = [c for c in rows.columns if c not in self.names]
        more = [n for n in self.recursions if n not in self.names]
        return out.withColumn("old_", F.col("line_") == 0).select(*picked, *self.names, *more, "old_", F.explode(parts).alias("part_"))

    def write(self, rows: DataFrame, number: int) -> None:
        """The work of one micro-batch; doing it again gives the same folder."""
        self.step(rows, number, self.lateness_ns).repartition(F.col("part_"), F.col(KEY)).write.partitionBy("part_").mode("overwrite").parquet(self.folder(number))
        self._forget(rows.sparkSession, number - 2)

    def _forget(self, spark: SparkSession, number: int) -> None:
        """Drop a state that no replay can need any more."""
        if number >= 0:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(number)}/part_=state")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Run over all that is there."""
        self.claim(stream.sparkSession)
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def read(self, spark: SparkSession, columns: T.StructType, part: str = "out") -> DataFrame:
        """Rows that came out so far with their features (part `out`), or late ones (`late`).
        columns: the schema of the stream's rows; boolean features are read as such."""
        kinds = dict(self._kinds(spark, columns))
        schema = T.StructType([*columns.fields, *(T.StructField(n, kinds[n]) for n in self.names), T.StructField("batch", T.LongType()), T.StructField("part_", T.StringType())])
        found = spark.read.schema(schema).parquet(f"{self.root}/batches").where(F.col("part_") == part)
        return found.select(*(f.name for f in columns.fields), *(self.names if part == "out" else []))

    def _kinds(self, spark: SparkSession, columns: T.StructType) -> list:
        out = self.step(spark.createDataFrame([], columns), 0, None)
        return [(f.name, f.dataType) for f in out.schema.fields]

    def last(self, spark: SparkSession) -> int | None:
        """The number of the last micro-batch, if there was one."""
        return spark.read.parquet(f"{self.root}/batches").agg(F.max("batch")).first()[0]

    def waiting(self, spark: SparkSession, columns: T.StructType) -> DataFrame:
        """Rows that aren't final yet, with their features if the stream ended here."""
        empty = spark.createDataFrame([], columns)
        return self.step(empty, self.last(spark) + 1, None).where("part_ = 'out'").select(*(f.name for f in columns.fields), *self.names)


def differences(a: DataFrame, b: DataFrame, names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """For each feature: rows of both tables together, and rows whose values differ (a row that
    only one table has differs in every feature)."""

    def differ(n: str) -> Column:
        x, y = F.col(f"a.{n}").cast("double"), F.col(f"b.{n}").cast("double")
        close = F.abs(x - y) <= tolerance * (1 + F.abs(x))
        return F.when(F.col("a.here_").isNull() | F.col("b.here_").isNull(), 1).when(x.isNull() & y.isNull(), 0).when(F.isnan(x) & F.isnan(y), 0).when(F.coalesce((x == y) | close, F.lit(False)), 0).otherwise(1)

    keys = [KEY, *ORDER]
    x, y = (t.select(*keys, *names, F.lit(True).alias("here_")).alias(k) for t, k in ((a, "a"), (b, "b")))
    j = x.join(y, reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys)), "full_outer")
    sums = j.agg(F.count("*").alias("rows"), *(F.sum(differ(n)).alias(n) for n in names))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col("rows"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("different")) for n in names))))
