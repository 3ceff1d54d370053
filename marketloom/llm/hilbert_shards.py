"""Shards along a Hilbert curve over metadata, for files that prune on several columns at once.

Language, source and text size are quantised into cells of near equal counts by cut points, which
are exact quantiles of all rows; the cell numbers of a row give its place on a Hilbert curve, and
rows close on the curve are close in every dimension. Rows are range-partitioned along the curve (ties by
digest of the text, then doc_id, so that even one hot cell spreads over tasks), numbered through
partition counts, and cut into runs whose row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.work import cut

SHARDS, BITS = 24, 6
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers (rows x dimensions), each below 2^bits.

    Skilling's transform: undo the excess rotations bit by bit, Gray-encode, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def cut_points(rows: DataFrame, cells: int) -> dict[str, list]:
    """For each dimension the distinct bounds that deal the values of all rows into at most `cells`
    runs of near equal counts; nulls count for none.

    Distinct values are counted, range-partitioned and written in order; partition totals say which
    of them hold the ranks of the bounds. Only the bounds reach the driver.
    """
    kinds = {c: "number" if c == "size" else "word" for c in DIMENSIONS}
    types = {"number": "long", "word": "string"}
    each = [F.struct(F.lit(c).alias("name"), *(F.col(c).alias(k) if k == own else F.lit(None).cast(types[k]).alias(k) for k in types)) for c, own in kinds.items()]
    value = ["name", "number", "word"]
    counts = rows.select(F.inline(F.array(*each))).where("number is not null or word is not null").groupBy(*value).agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange(*value).sortWithinPartitions(*value).withColumn("part", F.spark_partition_id()), "values")
    whole, before = Window.partitionBy("name"), Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("name", "part").agg(F.sum("n").alias("in_part"))  # a row per partition and dimension
    parts = parts.select("name", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"), F.sum("in_part").over(whole).alias("total"))
    upto = Window.partitionBy("name", "part").orderBy("number", "word").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(parts), ["name", "part"]).withColumn("end", F.col("before") + F.col("upto"))
    # bounds are the values of rank total * k div cells; those below a rank e are (e * cells - 1) div total
    held = ends.where(f"end > n and (end * {cells} - 1) div total > ((end - n) * {cells} - 1) div total").select(*value).collect()
    return {c: sorted(r[own] for r in held if r["name"] == c) for c, own in kinds.items()}


def _along(batches: Iterator[pa.RecordBatch], cuts: dict[str, list], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = []
        for name in DIMENSIONS:
            column = b.column(name)
            if name == "size":
                cells.append(np.searchsorted(np.array(cuts[name], np.int64), column.to_numpy(), side="right"))
            else:
                codes = column.dictionary_encode()
                known = [0 if v is None else int(np.searchsorted(cuts[name], v, side="right")) if cuts[name] else 0 for v in codes.dictionary.to_pylist()]
                cells.append(np.array(known or [0])[codes.indices.fill_null(0).to_numpy()])
        h = hilbert_index(np.stack(cells, 1), bits)
        kept = [c for c in ("doc_id", "size", "text_crc32", "row") if c in b.schema.names]
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(h)], [*kept, "hilbert"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*b.schema.names, "part", "place"])
        at += n


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert of every row; with
    `whole` also the row itself, as a struct `row` of all columns.

    The law is `rows`: shards hold the same number of rows or one more. A null text has size 8
    and the digest of an empty text; null lang or source go to the first cell; repeated rows are
    placed side by side; fewer rows than shards leave shards empty; other columns are not read.
    """
    size = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []
    ready = docs.select(docs["doc_id"], docs["lang"], docs["source"], size.alias("size"), crc.alias("text_crc32"), *row)
    cuts = cut_points(ready, 1 << bits)
    kind = T.StructType([f for f in ready.schema.fields if f.name not in ("lang", "source")] + [T.StructField("hilbert", T.LongType())])
    numbered = T.StructType([*kind.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    line = ready.mapInArrow(lambda it: _along(it, cuts, bits), kind)
    order = ["hilbert", "text_crc32", "doc_id", "size"]
    line = cut(
        line.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_numbered, numbered),
        "curve",
    )
    counts = sorted((r["part"], r["count"]) for r in line.groupBy("part").count().collect())  # one per partition
    total = sum(n for _, n in counts)
    starts = zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0))
    table = docs.sparkSession.createDataFrame(list(starts), "part int, before long")  # a row per partition
    rank = line.join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("place"))
    placed = rank.withColumn("shard", F.expr(f"cast(((rank + 1) * {shards} - 1) div {max(1, total)} as int)"))
    first = F.expr(f"cast(shard as long) * {total} div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", *(["row"] if whole else [])
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **parameters) -> DataFrame:
    """Write docs to path as files of one shard each (folders shard=K, rows along the curve), and
    return what a reader prunes by: shard, rows, bytes, and the least and greatest hilbert, lang,
    source and size of each shard. Empty shards have no files and no row. If docs have a column
    named shard, folders are named shard_=K (with as many underscores as it takes), and the
    column stays."""
    folder = "shard"
    while folder in map(str.lower, docs.columns):
        folder += "_"
    placed = shard(docs, shards, whole=True, **parameters)
    rows = placed.select("shard", "slot", "size", "hilbert", "row")
    written = rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    written.select(F.col("shard").alias(folder), *(F.col(f"row.{c}").alias(c) for c in docs.columns)).write.partitionBy(folder).parquet(path)
    ends = [f(c).alias(f"{name}_{c.split('.')[-1]}") for c in ("hilbert", "row.lang", "row.source", "size") for f, name in ((F.min, "least"), (F.max, "greatest"))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)
