"""Shared helpers: where intermediate tables go, how lineage is cut, how text reaches numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Unset is accepted on a local master only, where one machine runs everything.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later uses don't recompute it,
    and a lost executor costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """At most n rows of df: those whose key hashes lowest, always the same ones.

    Of a large table only about 4n rows pass a threshold on the hash, so that the ordering task
    reads no more as the table grows. For fitting only; everything fitted then covers all rows.
    """
    rows = df.count()
    h = F.xxhash64(*key)
    if rows > 4 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(4 * n / rows * (1 << 30)))
    return df.orderBy(h, *key).limit(n)


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with what an operator adds."""
    return df.select(*(df[c] for c in columns))


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def offsets(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column without nulls."""
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False), offsets(np.asarray(column.value_lengths()))


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
