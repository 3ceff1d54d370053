"""Building blocks for long histories: halo blocks, prefix totals, affine scans, folds, as-of.

A plain window over an instrument puts its whole history into one task. Here histories are cut
into blocks that any task can take: rows are numbered through bucket counts, a block gets copies
of the rows around it that its windows need (`halo`), running totals come from block summaries
(`prefix`), and linear recursions compose block by block (`affine_scan`). Only `fold`, for state
machines that cannot be composed, keeps one instrument in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.functions.ints import idiv
from marketloom.schemas import DAY, KEY, ORDER

#: Rows of one block.
BLOCK = 65_536


def numbered(df: DataFrame, keys=(KEY,), order=ORDER, width: int = DAY) -> DataFrame:
    """df with `ord_`: each row's place (from 0) in its key's history; kept if it is there, so that
    a chain of scans over the same rows numbers them once.

    Buckets of `width` in the first order column are counted, and counts are summed over the
    small table of buckets; rows are numbered inside their bucket only. Ties in the order are
    settled by a digest of the row, so that every reading numbers them alike.
    """
    if "ord_" in df.columns:  # numbered before
        return df
    keys = list(keys)
    df = df.withColumn("bucket_", idiv(F.col(order[0]), width))
    counts = df.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    digest = F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and c != "bucket_"))
    inside = Window.partitionBy(*keys, "bucket_").orderBy(*order, digest)
    placed = df.withColumn("row_", F.row_number().over(inside)).join(starts, [*keys, "bucket_"])
    return placed.withColumn("ord_", F.col("start_") + F.col("row_") - 1).drop("bucket_", "start_", "row_")


def settled(df: DataFrame) -> DataFrame:
    """df written once to the folder that executors share, and read back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/marketloom-scan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def halo(df: DataFrame, lookback: int, lookahead: int = 0, block: int = BLOCK, keys=(KEY,), order=ORDER, width: int = DAY) -> DataFrame:
    """Rows in blocks with copies of the rows that windows reach: adds `ord_`, `block_`, `home_`.

    Windows of up to `lookback` rows before and `lookahead` rows after are exact on rows where
    `home_`; the copies are dropped afterwards (`home`).
    """
    rows = numbered(df, keys, order, width)
    first = F.greatest(F.lit(0), F.floor((F.col("ord_") - lookahead) / block))
    last = F.floor((F.col("ord_") + lookback) / block)
    rows = rows.withColumn("block_", F.explode(F.sequence(first, last)))
    return rows.withColumn("home_", F.col("block_") == F.floor(F.col("ord_") / block))


def home(df: DataFrame) -> DataFrame:
    return df.where("home_").drop("home_", "block_")


def prefix(df: DataFrame, values: dict[str, Column], block: int = BLOCK, keys=(KEY,), order=ORDER) -> DataFrame:
    """df with running sums up to and with each row: block totals first, then rows in blocks."""
    keys = list(keys)
    rows = numbered(df, keys, order).withColumn("block_", F.floor(F.col("ord_") / block)).withColumns({f"{k}_v": v for k, v in values.items()})
    totals = rows.groupBy(*keys, "block_").agg(*(F.sum(f"{k}_v").alias(f"{k}_t") for k in values))
    before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "block_", *(F.coalesce(F.sum(f"{k}_t").over(before), F.lit(0)).alias(f"{k}_s") for k in values))
    line = Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, [*keys, "block_"])
    rows = rows.withColumns({k: F.col(f"{k}_s") + F.coalesce(F.sum(f"{k}_v").over(line), F.lit(0)) for k in values})
    return rows.drop("block_", *(f"{k}_{x}" for k in values for x in "vs"))


def running_max(df: DataFrame, value: str, out: str, block: int = BLOCK, keys=(KEY,), order=ORDER) -> DataFrame:
    """df with the largest value so far, by block maxima and rows in blocks."""
    keys = list(keys)
    rows = numbered(df, keys, order).withColumn("block_", F.floor(F.col("ord_") / block))
    tops = rows.groupBy(*keys, "block_").agg(F.max(value).alias("top_"))
    before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(*keys, "block_", F.max("top_").over(before).alias("start_"))
    line = Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, [*keys, "block_"])
    return rows.withColumn(out, F.greatest("start_", F.max(value).over(line))).drop("block_", "start_")


def affine_scan(df: DataFrame, recursions: dict[str, tuple[str, str]], block: int = BLOCK, keys=(KEY,), order=ORDER) -> DataFrame:
    """df with y = a * y_before + b for each name: (a, b) columns, over each key's history.

    A row whose a is null restarts at b; a row whose b is null keeps y. Blocks fold to one map
    each, the few maps of a key are composed in order, and blocks run again from their start.
    Numbered rows are written when this is called.
    """
    keys, names = list(keys), list(recursions)
    rows = numbered(df, keys, order).withColumn("block_", F.floor(F.col("ord_") / block))
    for n, (a, b) in recursions.items():
        rows = rows.withColumn(f"{n}_a", F.when(F.col(b).isNull(), 1.0).otherwise(F.coalesce(F.col(a), F.lit(0.0))))
        rows = rows.withColumn(f"{n}_b", F.coalesce(F.col(b), F.lit(0.0)))
        # whether any value has been seen up to here, so that rows before the first stay null
        rows = rows.withColumn(f"{n}_c", F.col(b).isNotNull().cast("double"))

    rows = settled(rows)  # it is read twice from here
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "block_"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord_")
        out = {k: table.column(k).slice(0, 1) for k in (*keys, "block_")}
        for n in names:
            a, b = affine_map(*(table.column(f"{n}_{x}").to_numpy() for x in "ab"))
            out |= {f"{n}_a": [a], f"{n}_b": [b], f"{n}_c": [table.column(f"{n}_c").to_numpy().max()]}
        return pa.table(out)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_")
        out = {k: pdf[k].to_numpy() for k in (*keys, "block_")}
        for n in names:
            y, seen, starts, known = 0.0, 0.0, [], []
            for a, b, c in zip(pdf[f"{n}_a"], pdf[f"{n}_b"], pdf[f"{n}_c"]):
                starts.append(y)
                known.append(seen)
                y, seen = a * y + b, max(seen, c)
            out |= {f"{n}_y": starts, f"{n}_k": known}
        return pd.DataFrame(out)

    maps = rows.select(*keys, "block_", "ord_", *(f"{n}_{x}" for n in names for x in "abc")).groupBy(*keys, "block_")
    maps = maps.applyInArrow(fold, key_ddl + "".join(f", {n}_{x} double" for n in names for x in "abc"))
    starts = maps.groupBy(*keys).applyInPandas(chain, key_ddl + "".join(f", {n}_{x} double" for n in names for x in "yk"))
    kept = [f for f in rows.schema.fields if f.name not in {"block_", *(f"{n}_{x}" for n in names for x in "abc")}]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord_")
        out = {c: table.column(c) for c in columns}
        for n in names:
            a, b, c = (table.column(f"{n}_{x}").to_numpy() for x in "abc")
            seen = (np.maximum.accumulate(c) > 0) | (table.column(f"{n}_k")[0].as_py() > 0)
            out[n] = pa.array(affine_run(a, b, table.column(f"{n}_y")[0].as_py()), mask=~seen)
        return pa.table(out)

    columns = [f.name for f in kept]
    solved = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in names])
    return rows.join(starts, [*keys, "block_"]).groupBy(*keys, "block_").applyInArrow(run, solved)


def _columns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps in rows of about the square root of their number, filled up with maps that keep y."""
    wide = max(1, int(np.ceil(np.sqrt(len(a)))))
    more = -len(a) % wide
    return np.append(a, np.ones(more)).reshape(-1, wide), np.append(b, np.zeros(more)).reshape(-1, wide)


def _compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map for each row of maps."""
    x, y = np.ones(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        x, y = a[:, k] * x, a[:, k] * y + b[:, k]
    return x, y


def affine_map(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """All maps y -> a y + b, one after the other, as one."""
    x, y = _compose(*(m.reshape(1, -1) for m in _compose(*_columns(a, b))))
    return float(x[0]), float(y[0])


def affine_run(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """Every value on the way from y through all maps: rows of maps side by side."""
    n = len(a)
    a, b = _columns(a, b)
    starts = []
    for x, z in zip(*_compose(a, b)):
        starts.append(y)
        y = x * y + z
    out, y = np.empty(a.shape), np.array(starts)
    for k in range(a.shape[1]):
        y = a[:, k] * y + b[:, k]
        out[:, k] = y
    return out.ravel()[:n]


def ema(df: DataFrame, outs: dict[str, tuple[str, float]], **parameters) -> DataFrame:
    """df with exponential means: out -> (column, alpha), seeded with the first value."""
    cols = {}
    for out, (x, alpha) in outs.items():
        cols[f"{out}_b0"] = F.col(x) * alpha
        cols[f"{out}_x0"] = F.col(x)
    df = df.withColumns(cols)
    # the first value enters whole: find it per key, not by a window over the history
    firsts = df.groupBy(KEY).agg(*(F.min(F.when(F.col(f"{o}_x0").isNotNull(), F.struct(*ORDER))).alias(f"{o}_f") for o in outs))
    df = df.join(firsts, KEY)
    made = {}
    for out, (x, alpha) in outs.items():
        first = F.struct(*ORDER) == F.col(f"{out}_f")
        made[f"{out}_a0"] = F.when(first, F.lit(0.0)).otherwise(F.lit(1.0 - alpha))
        made[f"{out}_b0"] = F.when(first, F.col(x)).otherwise(F.col(f"{out}_b0"))
    df = df.withColumns(made)
    scanned = affine_scan(df, {o: (f"{o}_a0", f"{o}_b0") for o in outs}, **parameters)
    return scanned.drop(*(f"{o}_{s}" for o in outs for s in ("a0", "b0", "x0", "f")))


def recursions(df: DataFrame, names: list[str], **parameters) -> DataFrame:
    """df with y = a y_before + b for each name, from columns <name>_a0, _b0 and _s0 (the value of
    the first row whose b isn't null)."""
    firsts = df.groupBy(KEY).agg(*(F.min(F.when(F.col(f"{n}_b0").isNotNull(), F.struct(*ORDER))).alias(f"{n}_f0") for n in names))
    df = df.join(firsts, KEY)
    first = {n: F.struct(*ORDER) == F.col(f"{n}_f0") for n in names}
    df = df.withColumns({f"{n}_a0": F.when(first[n], 0.0).otherwise(F.col(f"{n}_a0")) for n in names} | {f"{n}_b0": F.when(first[n], F.col(f"{n}_s0")).otherwise(F.col(f"{n}_b0")) for n in names})
    return affine_scan(df, {n: (f"{n}_a0", f"{n}_b0") for n in names}, **parameters).drop(*(f"{n}_{x}0" for n in names for x in "absf"))


def fold(df: DataFrame, step: Callable[[Iterator[tuple], str], Iterable[tuple]], columns: list[str], schema: str, key: str = KEY, order=ORDER) -> DataFrame:
    """One pass of a state machine over each key's ordered rows.

    `step` gets an iterator over the rows (tuples of `columns`; NaN as None) of one key and the
    key, and yields output tuples in `schema`. Rows are sorted by Spark and stream through, so a
    task holds a batch and the state, however long a history is. Parallel across keys only, as
    the state cannot be split; inputs that windows can give should be computed before.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def values(column: pa.Array) -> list:
        out = column.to_pylist()
        return [None if v != v else v for v in out] if pa.types.is_floating(column.type) else out

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(key).to_pylist(), *(values(b.column(c)) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

        for k, rows in groupby(stream(batches), key=lambda r: r[0]):
            for made in step((r[1:] for r in rows), k):
                held.append(made)
                if len(held) == 8192:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    picked = df.select(key, *order, *(c for c in columns if c not in (key, *order)))
    return picked.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


#: Rows before a block from which a guessed state runs up to it, and rounds of guesses that are
#: mended before the rest is run in order.
WARM, ROUNDS = 4096, 8
Run = Callable[[dict[str, np.ndarray], float], tuple[float, int, dict[str, np.ndarray]]]


def speculate(df: DataFrame, run: Run, guess: Callable[[dict[str, np.ndarray]], float], columns: list[str], made: str, block: int = BLOCK, warm: int = WARM, rounds: int = ROUNDS, key: str = KEY) -> DataFrame:
    """df (with `ord_`) through a state machine, block by block side by side: adds the columns of
    the schema `made`, and `before_`, what was counted in earlier blocks.

    `run` takes arrays of `columns` and the state before them (one number), and gives the state
    after them, a count, and the made columns; `guess` gives a state to start from, which must be
    the true one on a key's first row. A block starts from what a guess has become `warm` rows
    later; machines that forget their past mostly are in the true state by then. Where the end of
    the block before says otherwise, the block runs again from there, until all blocks agree.
    After `rounds` of this the rest runs in order, a key in one task, so the result is always that
    of one pass. Rows and the blocks' states are written when this is called.
    """
    rows = settled(numbered(df))
    own = F.floor(F.col("ord_") / block)
    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == key)
    summary = f"`{key}` {kind}, block_ long, start_ double, end_ double, count_ long"

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: table.column(c).to_numpy(zero_copy_only=False) for c in columns}

    def told(table: pa.Table, start: float, end: float, count: int) -> pa.Table:
        return pa.table({key: table.column(key).slice(0, 1), "block_": table.column("block_").slice(0, 1), "start_": [float(start)], "end_": [float(end)], "count_": [count]})

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord_")
        here = arrays(table)
        n = int(len(table) - table.column("home_").to_numpy(zero_copy_only=False).sum())  # copies come first
        start = run({c: x[:n] for c, x in here.items()}, guess(here))[0]
        return told(table, start, *run({c: x[n:] for c, x in here.items()}, start)[:2])

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord_")
        start = table.column("start_")[0].as_py()
        return told(table, start, *run(arrays(table), start)[:2])

    sums = settled(halo(rows, warm, block=block, keys=(key,)).groupBy(key, "block_").applyInArrow(first, summary))
    line = Window.partitionBy(key).orderBy("block_")
    for turn in range(rounds + 1):
        wrong = sums.select(key, "block_", "start_", F.lag("end_").over(line).alias("true_")).where("true_ <> start_").select(key, "block_", F.col("true_").alias("start_"))
        if not wrong.limit(1).count():
            break
        if turn == rounds:
            sums = settled(fold(rows, _in_order(run, guess, columns, block), ["ord_", *columns], summary, key, ("ord_",)))
            break
        redone = rows.withColumn("block_", own).join(wrong, [key, "block_"]).groupBy(key, "block_").applyInArrow(again, summary)
        sums = settled(sums.join(wrong.select(key, "block_"), [key, "block_"], "left_anti").unionByName(redone))
    before = F.coalesce(F.sum("count_").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(key, "block_", "start_", before.alias("before_"))
    schema = T.StructType([*rows.schema.fields, T.StructField("before_", T.LongType()), *T._parse_datatype_string(made).fields])

    def emit(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord_")
        new = run(arrays(table), table.column("start_")[0].as_py())[2]
        kept = [f.name for f in schema.fields if f.name not in new]
        return pa.table({c: table.column(c) for c in kept} | {c: pa.array(x) for c, x in new.items()}).select([f.name for f in schema.fields])

    return rows.withColumn("block_", own).join(starts, [key, "block_"]).groupBy(key, "block_").applyInArrow(emit, schema)


def _in_order(run: Run, guess: Callable, columns: list[str], block: int) -> Callable[[Iterator[tuple], str], Iterator[tuple]]:
    """A step of `fold` that gives the states of one key's blocks, one after the other."""

    def step(history: Iterator[tuple], key: str) -> Iterator[tuple]:
        state = None
        for number, part in groupby(history, key=lambda r: r[0] // block):
            here = {c: np.array(x) for c, x in zip(columns, list(zip(*part))[1:])}
            start = guess(here) if state is None else state
            state, count, _ = run(here, start)
            yield key, number, float(start), float(state), count

    return step


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of df in an order, however many they are: rows are range-partitioned,
    sorted and written, and whole partitions are counted off. No task orders all rows."""
    line = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    line = settled(line).withColumns({"part_": F.shiftright("place_", 33), "place_": F.col("place_").bitwiseAND((1 << 33) - 1)})
    before = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = line.groupBy("part_").agg(F.count("*").alias("n_"))  # a row per partition
    starts = counts.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return line.join(F.broadcast(starts), "part_").where(F.col("start_") + F.col("place_") < n).drop("part_", "place_", "start_")


#: Steps of a value's logarithm in which `medians` counts values first.
STEPS = 4096


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The exact median of each key's values that aren't null (null if all are; NaN is the largest).

    Values are counted in steps of a logarithmic scale (some 200,000 for each sign, whatever the
    table), and only the steps that hold a middle rank are counted value by value. A key's task
    sees those counts, not its values.
    """
    x = F.col("x_")
    rows = df.select(*keys, F.col(value).cast("double").alias("x_"))
    some = rows.where(x.isNotNull())
    step = F.when(F.isnan(x), (1 << 63) - 1).otherwise((F.signum(x) * F.floor(F.log1p(F.abs(x) * (1 << 20)) * STEPS)).cast("long"))
    some = some.withColumn("step_", F.when(x == 0, 0).otherwise(step))
    counts = some.groupBy(*keys, "step_").agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("step_").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"all_": F.sum("n_").over(whole), "start_": F.sum("n_").over(upto) - F.col("n_")})
    low, high = F.expr("(all_ - 1) div 2"), F.expr("all_ div 2")
    middle = counts.where((F.col("start_") <= high) & (F.col("start_") + F.col("n_") > low)).drop("n_")
    # written first, so that Spark knows how few steps there are and drops other values before any shuffle
    middle = settled(middle)
    values = some.join(middle, [*keys, "step_"]).groupBy(*keys, "step_", "x_", "start_", "all_").agg(F.count("*").alias("n_"))
    upto = Window.partitionBy(*keys, "step_").orderBy("x_").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("end_", F.col("start_") + F.sum("n_").over(upto))
    holds = lambda rank: (F.col("end_") - F.col("n_") <= rank) & (F.col("end_") > rank)
    found = values.groupBy(*keys).agg(((F.max(F.when(holds(low), x)) + F.max(F.when(holds(high), x))) / 2).alias(out))
    return rows.select(*keys).distinct().join(found, keys, "left")


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key's values that aren't null, by name, linear between two values
    where the rank falls between them; counted as in `medians`. Keys without values have nulls."""
    x = F.col("x_")
    rows = df.select(*keys, F.col(value).cast("double").alias("x_"))
    step = F.when(F.isnan(x), (1 << 63) - 1).when(x == 0, 0).otherwise((F.signum(x) * F.floor(F.log1p(F.abs(x) * (1 << 20)) * STEPS)).cast("long"))
    some = rows.where(x.isNotNull()).withColumn("step_", step)
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("step_").rowsBetween(Window.unboundedPreceding, 0)
    counts = some.groupBy(*keys, "step_").agg(F.count("*").alias("n_"))
    counts = counts.withColumns({"all_": F.sum("n_").over(whole), "start_": F.sum("n_").over(upto) - F.col("n_")})
    asked = F.array(*(F.struct(F.lit(name).alias("name_"), F.lit(float(q)).alias("q_")) for name, q in points.items()))
    ranks = counts.select(*keys, "step_", "n_", "start_", "all_", F.inline(asked)).withColumn("at_", (F.col("all_") - 1) * F.col("q_"))
    ranks = ranks.withColumns({"low_": F.floor("at_"), "high_": F.ceil("at_")}).where((F.col("start_") <= F.col("high_")) & (F.col("start_") + F.col("n_") > F.col("low_"))).drop("n_")
    values = some.groupBy(*keys, "step_", "x_").agg(F.count("*").alias("n_")).join(ranks, [*keys, "step_"])
    upto = Window.partitionBy(*keys, "step_", "name_").orderBy("x_").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("end_", F.col("start_") + F.sum("n_").over(upto))
    holds = lambda rank: F.max(F.when((F.col("end_") - F.col("n_") <= F.col(rank)) & (F.col("end_") > F.col(rank)), x))
    found = values.groupBy(*keys, "name_").agg(holds("low_").alias("a_"), holds("high_").alias("b_"), F.max(F.col("at_") - F.col("low_")).alias("part_"))
    found = found.withColumn("v_", F.when(F.col("part_") > 0, F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("part_")).otherwise(F.col("a_")))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name_") == name, F.col("v_"))).alias(name) for name in points))
    return rows.select(*keys).distinct().join(wide, keys, "left")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], prefix: str = "", forward: bool = False, key: str = KEY, time: str = "event_time_ns", tie: str = "seq", width: int = DAY) -> DataFrame:
    """left with the latest right row at or before its time (or the first at or after it).

    Both sides are unioned and ordered inside time buckets, so a bucket is a task's work; what a
    bucket starts with is the last right row of earlier buckets, carried over the bucket summary.
    Right rows of one time: the largest tie (forward: the smallest) counts. No range join is made.
    """
    sign = -1 if forward else 1
    value = F.struct(F.col(time).alias("t_"), F.col(tie).alias("s_"), *columns)
    a = left.withColumn("side_", F.lit(1)).withColumn("value_", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("tie_", F.lit(0).cast("long"))
    b = right.select(F.col(key), F.col(time), F.lit(0).alias("side_"), value.alias("value_"), (F.col(tie) * sign).cast("long").alias("tie_"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("bucket_", idiv(F.col(time), width) * sign)
    pick = F.max if not forward else F.min
    ends = rows.where("side_ = 0").groupBy(key, "bucket_").agg(pick("value_").alias("end_"))
    seen = rows.select(key, "bucket_").distinct().join(ends, [key, "bucket_"], "left")
    before = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.select(key, "bucket_", F.last("end_", ignorenulls=True).over(before).alias("carry_"))
    line = Window.partitionBy(key, "bucket_").orderBy(F.col(time) * sign, "side_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("found_", F.last("value_", ignorenulls=True).over(line)).where("side_ = 1")
    found = found.join(carry, [key, "bucket_"], "left").withColumn("found_", F.coalesce("found_", "carry_"))
    extra = [F.col(f"found_.{c}").alias(f"{prefix}{c}") for c in columns]
    return found.select(*(found[c] for c in left.columns), F.col("found_.t_").alias(f"{prefix}asof_time_ns"), *extra)


def time_halo(df: DataFrame, span: int, bucket: int, time: str = "event_time_ns") -> DataFrame:
    """Rows in time buckets with copies for trailing windows of `span` time units: adds `block_`
    and `home_`. Needs no numbering, as a window's reach is a time here. Rows without a time share
    a block without a number."""
    first, last = idiv(F.col(time), bucket), idiv((F.col(time) + F.lit(span - 1)), bucket)
    rows = df.withColumn("block_", F.explode_outer(F.sequence(first, last))).withColumn("home_", F.col("block_").eqNullSafe(first))
    return rows
