"""Labels, splits and training sets without look-ahead leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.features import REGISTRY
from marketloom.operators import research, scan
from marketloom.operators.bars import trading_date
from marketloom.schemas import KEY, ORDER

CODES = {"NO_TRADE": 0, "LONG": 1, "SHORT": 2}
HORIZON = 15


def build(bars: DataFrame, horizon: int = HORIZON, long_at: float = 0.0022, short_at: float = 0.0022, long_only: bool = False) -> DataFrame:
    """bars with future_return, label_class, label_code, label_horizon_ts and is_valid.

    LONG above long_at, SHORT below -short_at (unless long_only), else NO_TRADE; the last
    `horizon` rows of an instrument have no label and are invalid.
    """
    rows = scan.halo(bars, 0, horizon)
    line = Window.partitionBy(KEY, "block_").orderBy(*ORDER)
    rows = rows.withColumns({"c_": F.lead("close", horizon).over(line), "label_horizon_ts": F.lead("event_time_ns", horizon).over(line)})
    rows = scan.home(rows).withColumn("future_return", F.col("c_") / F.nullif(F.col("close"), F.lit(0.0)) - 1).drop("c_")
    short = F.lit(False) if long_only else F.col("future_return") < -short_at
    label = F.when(F.col("future_return").isNull(), None).when(F.col("future_return") > long_at, "LONG").when(short, "SHORT").otherwise("NO_TRADE")
    rows = rows.withColumn("label_class", label).withColumn("is_valid", F.col("future_return").isNotNull())
    code = F.lit(None).cast("int")
    for name, k in CODES.items():
        code = F.when(F.col("label_class") == name, k).otherwise(code)
    return rows.withColumn("label_code", code).withColumn("label_horizon", F.lit(horizon))


def threshold(fee: float, buffer: float) -> float:
    """The return that pays both fees and a buffer."""
    return 2 * fee + buffer


def distribution(labels: DataFrame) -> DataFrame:
    """Rows of each class, among valid ones."""
    return labels.where("is_valid").groupBy("label_class").agg(F.count("*").alias("n"))


def split_of(time: str, splits: dict[str, tuple[str, str]]) -> Column:
    """Name of the split whose inclusive UTC dates hold the time, or null. Splits must not
    overlap."""
    spans = sorted((a, b, n) for n, (a, b) in splits.items())
    for (a, b, n), (a2, _, n2) in zip(spans, spans[1:]):
        if a2 <= b:
            raise ValueError(f"splits {n} and {n2} overlap")
    day, out = trading_date(time), F.lit(None).cast("string")
    for a, b, n in spans:
        if b < a:
            raise ValueError(f"split {n} ends before it begins")
        out = F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), n).otherwise(out)
    return out


def assign(rows: DataFrame, splits: dict[str, tuple[str, str]]) -> DataFrame:
    return rows.withColumn("split", split_of("event_time_ns", splits))


def is_leaky(splits: dict[str, tuple[str, str]]) -> Column:
    """Whether a row's label horizon lies in another split than the row, or in none."""
    end = split_of("label_horizon_ts", splits)
    return F.col("split").isNotNull() & F.col("label_horizon_ts").isNotNull() & ~F.coalesce(end == F.col("split"), F.lit(False))


def purge(rows: DataFrame, splits: dict[str, tuple[str, str]]) -> DataFrame:
    return rows.where(~is_leaky(splits))


def summary(rows: DataFrame) -> DataFrame:
    return rows.where("split is not null").groupBy("split").agg(F.count("*").alias("n"))


def dataset(bars: DataFrame, features: list[str], splits: dict[str, tuple[str, str]], **label) -> DataFrame:
    """Bars with features, labels, splits and the one reason for which a row is dropped, in the
    order no_split, horizon, purge, warmup, nan_feature; kept rows have none.

    A row is warm-up if it comes before the instrument's first row with all features.
    """
    rows = assign(build(REGISTRY.compute(bars, features), **label), splits)
    whole = F.lit(True)
    for c in features:
        whole &= F.col(c).isNotNull()
    at = F.struct(*ORDER)
    first = rows.where(whole).groupBy(KEY).agg(F.min(at).alias("first_"))
    rows = rows.join(first, KEY, "left")
    reason = (
        F.when(F.col("split").isNull(), "no_split")
        .when(~F.col("is_valid"), "horizon")
        .when(is_leaky(splits), "purge")
        .when(F.col("first_").isNull() | (at < F.col("first_")), "warmup")
        .when(~whole, "nan_feature")
    )
    return rows.withColumn("drop_reason", reason).drop("first_")


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("drop_reason is null").drop("drop_reason")


def drop_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def class_rollup(rows: DataFrame) -> DataFrame:
    """Kept rows by split and class with subtotals."""
    return kept(rows).rollup("split", "label_class").agg(F.count("*").alias("n"))


def typed(rows: DataFrame, features: list[str]) -> DataFrame:
    """Storage types: float features, double prices, small codes."""
    return rows.select(
        "event_time_ns", KEY, "split", F.col("close").alias("close_t"), F.col("label_horizon").cast("smallint").alias("label_horizon"), "label_horizon_ts",
        "future_return", "label_class", F.col("label_code").cast("tinyint").alias("label_code"), "is_valid", *(F.col(c).cast("float").alias(c) for c in features),
    )


def write(rows: DataFrame, path: str, features: list[str], splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """Kept rows of the chosen splits as Parquet by split and month."""
    ready = typed(kept(rows).where(F.col("split").isin(*splits)), features).withColumn("month", F.date_format(trading_date(), "yyyy-MM"))
    ready.repartition("split", "month").sortWithinPartitions(KEY, "event_time_ns").write.mode("overwrite").partitionBy("split", "month").parquet(path)


V1_FEATURES, V2_FEATURES = research.V1, [*research.V1, *research.V2]
