"""Training sets from stored feature events: several feature sets stacked, joined exactly, or
joined as of each row's time, with labels from after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import scan
from marketloom.schemas import KEY
from marketloom.sources.catalog import feature_query

#: Columns that every event has; the others are features.
META = ("ts_event", KEY, "feature_set_id", "feature_version", "is_warmup")
#: Of these, what a joined row has once.
KEPT = ("ts_event", KEY, "is_warmup")
#: Milliseconds of a day, the buckets of as-of joins.
DAY_MS = 86_400_000


def _as_of(left: DataFrame, right: DataFrame, columns: list[str], forward: bool = False) -> DataFrame:
    tied = lambda df: df.withColumn("tie_", F.lit(0))  # noqa: E731  one row for each time, instrument and set
    return scan.as_of(tied(left), tied(right), columns, forward=forward, time="ts_event", tie="tie_", width=DAY_MS).drop("tie_", "asof_time_ns")


def load(events: DataFrame, sets: list[str], ids: list[str] | None = None, start: int | None = None, end: int | None = None, warmup: bool = False, select: list[str] | dict[str, list[str]] | None = None, join: str = "concat", keys: tuple[str, ...] = (KEY, "ts_event"), prefix: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Events of some feature sets as rows to train on.

    join: `concat` stacks the sets (in order of time), `exact` keeps the rows whose keys all sets
    have, `asof` gives each row of the first set the latest row of each other set at or before
    it, never a later one. Joined columns are named <set>__<column>, without `prefix` by their own
    names, and of equal names the first set's stays. select: feature columns of all sets, or of
    each (sets that it doesn't name keep all). A set without events is left out; without any the
    result has no rows. labels: a table by instrument and time, of which each row gets the first
    at or after it (columns that the row has already are dropped).
    """
    if join not in ("concat", "exact", "asof"):
        raise ValueError(f"unknown join {join!r}: concat, exact or asof")
    features = [c for c in events.columns if c not in META]
    parts = {}
    for name in sets:
        own = select.get(name) if isinstance(select, dict) else select
        columns = [c for c in events.columns if c in META or own is None or c in own]
        parts[name] = feature_query(events.select(*columns), ids, [name], start, end, warmup)
    if join == "concat":
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
    else:
        held = {r["feature_set_id"] for r in events.where(F.col("feature_set_id").isin(sets)).select("feature_set_id").distinct().collect()}  # names only
        used = [n for n in sets if n in held] or sets[:1]
        named = {n: parts[n].select(*(F.col(c).alias(c if c in KEPT or not prefix else f"{n}__{c}") for c in parts[n].columns)) for n in used}
        out = named[used[0]]
        for n in used[1:]:
            new = [c for c in named[n].columns if c not in out.columns]
            out = out.join(named[n].select(*keys, *(c for c in new if c not in keys)), list(keys)) if join == "exact" else _as_of(out, named[n].select(KEY, "ts_event", *new), new)
    if labels is not None:
        new = [c for c in labels.columns if c not in out.columns]
        out = _as_of(out, labels.select(KEY, "ts_event", *new), new, forward=True)
    first = [c for c in ("ts_event", KEY) if c in out.columns]
    return out.select(*first, *(c for c in out.columns if c not in first)).orderBy(*first) if features else out


def describe(data: DataFrame, sets: list[str]) -> DataFrame:
    """One row about a loaded set: used_feature_sets, row_count, columns, and the times it spans."""
    if "feature_set_id" in data.columns:
        used = F.array_sort(F.collect_set("feature_set_id"))  # at most as many as were asked for
    else:
        used = F.array(*(F.lit(n) for n in sets if any(c.startswith(f"{n}__") for c in data.columns)))
        used = F.when(F.count("*") > 0, used).otherwise(F.array().cast("array<string>"))
    return data.agg(used.alias("used_feature_sets"), F.count("*").alias("row_count"), F.lit(",".join(data.columns)).alias("columns"), F.min("ts_event").alias("start"), F.max("ts_event").alias("end"))
