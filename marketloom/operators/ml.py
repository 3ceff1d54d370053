"""Baselines and their evaluation on pyspark.ml: fitting, scores, thresholds, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.ints import idiv
from marketloom.operators import boosting, scan
from marketloom.schemas import DAY

#: Codes of classes.
NO_TRADE, LONG, SHORT = 0, 1, 2


def balanced(rows: DataFrame, label: str = "label_code") -> DataFrame:
    """rows with weights that give every class the same total."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_"))  # a row per class
    weights = counts.withColumns({"t_": F.sum("n_").over(Window.partitionBy(F.lit(0))), "k_": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return rows.join(F.broadcast(weights.select(label, (F.col("t_") / (F.col("k_") * F.col("n_"))).alias("weight"))), label)


def fit_logistic(train: DataFrame, features: list[str], label: str = "label_code", iterations: int = 30):
    """Scaled, class-balanced multinomial logistic regression: a function from rows to rows with
    one probability per class."""
    assembler = VectorAssembler(inputCols=features, outputCol="raw_", handleInvalid="skip")
    rows = assembler.transform(balanced(train, label))
    scaler = StandardScaler(inputCol="raw_", outputCol="x_", withMean=True).fit(rows)
    model = LogisticRegression(featuresCol="x_", labelCol=label, weightCol="weight", maxIter=iterations).fit(scaler.transform(rows))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(scaler.transform(assembler.transform(df)))
        p = vector_to_array("probability")
        return out.withColumns({"p_notrade": p[0], "p_long": p[1], "p_short": p[2], "predicted": F.col("prediction").cast("int")}).drop("raw_", "x_", "rawPrediction", "probability", "prediction")

    return predict


def fit_boosted(train: DataFrame, features: list[str], label: str = "label_code", valid: DataFrame | None = None, **parameters):
    """Boosted trees by histograms (`boosting.fit`): a function from rows to rows with one
    probability per class."""
    model = boosting.fit(train, features, label, valid, **parameters)
    return lambda df: boosting.predict(df, model).withColumn("predicted", likeliest())


def class_scores(rows: DataFrame, label: str = "y", predicted: str = "predicted") -> DataFrame:
    """Support, precision, recall and F1 of each class, from one count of pairs."""
    pairs = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h"), "n"), F.struct(F.col("p").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).cast("long").alias("h"), "n"))).alias("x")).select("x.*")
    s = long.groupBy(F.col("c").alias("class")).agg(F.sum(F.col("a") * F.col("n")).alias("support"), F.sum(F.col("b") * F.col("n")).alias("predicted"), F.sum("h").alias("hits"))
    precision, recall = F.col("hits") / F.nullif(F.col("predicted"), F.lit(0)), F.col("hits") / F.nullif(F.col("support"), F.lit(0))
    return s.withColumns({"precision": precision, "recall": recall, "f1": F.coalesce(2 * F.col("hits") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))})


def likeliest() -> Column:
    """The class of greatest probability; of ties short, then no trade."""
    best = F.greatest("p_notrade", "p_long", "p_short")
    return F.when(F.col("p_short") == best, SHORT).when(F.col("p_notrade") == best, NO_TRADE).otherwise(LONG)


def evaluate(rows: DataFrame, label: str = "y", predicted: str = "predicted") -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1, in one row."""
    s = class_scores(rows, label, predicted)
    n = F.sum("support")
    return s.agg((F.sum("hits") / n).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def confusion(rows: DataFrame, label: str = "y", predicted: str = "predicted", classes: int = 3) -> DataFrame:
    """How many rows of each class got each prediction, pairs that don't occur too."""
    cells = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(p).alias("predicted")) for y in range(classes) for p in range(classes)))
    every = rows.sparkSession.range(1).select(F.inline(cells))
    found = rows.groupBy(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return every.join(found, ["y", "predicted"], "left").fillna(0, ["n"])


#: Quantiles of the greatest probability that are reported.
POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def probability_summary(rows: DataFrame) -> DataFrame:
    """In one row: mean and exact quantiles of the greatest probability, and the mean probability
    of each class."""
    r = rows.select(F.lit(1).alias("k_"), F.greatest("p_notrade", "p_long", "p_short").alias("most_"), "p_notrade", "p_long", "p_short")
    means = r.groupBy("k_").agg(F.avg("most_").alias("max_prob_mean"), *(F.avg(c).alias(f"avg_{c}") for c in ("p_notrade", "p_long", "p_short")))
    return means.join(scan.quantiles(r, ["k_"], "most_", POINTS), "k_").drop("k_")


KINDS = ("long", "short", "both")


def signal_stats(signals: DataFrame, keys: list[str], total: DataFrame, groups: DataFrame, label_at: float, cost: float) -> DataFrame:
    """For each row of `groups` (columns `keys`) and kind (long, short, both): how many signals,
    their share of all rows and number a day, how often they are right, wrong and no trade, and
    what they return.

    signals: keys, side (1 long, 2 short), y, future_return; total: one row of n and days. Groups
    without signals have 0 and nulls. Medians are exact and come from counts of values.
    """
    signed = F.when(F.col("side") == LONG, F.col("future_return")).otherwise(-F.col("future_return"))
    own = F.when(F.col("side") == LONG, "long").otherwise("short")
    r = signals.select(*keys, "side", "y", signed.alias("r_"), F.explode(F.array(own, F.lit("both"))).alias("kind"))
    share = lambda c: F.avg(c.cast("double"))
    got = r.groupBy(*keys, "kind").agg(
        F.count("*").alias("signals"), share(F.col("y") == F.col("side")).alias("precision"), share(F.col("y") == 3 - F.col("side")).alias("wrong_rate"), share(F.col("y") == NO_TRADE).alias("no_trade_rate"), F.avg("r_").alias("avg_return"),
        share(F.col("r_") > 0).alias("positive_rate"), share(F.col("r_") > label_at).alias("label_hit_rate"), F.avg(F.col("r_") - cost).alias("net_of_cost"), F.avg(F.col("r_") - label_at).alias("net_of_label"),
    )
    got = got.join(scan.medians(r, [*keys, "kind"], "r_", "median_return"), [*keys, "kind"])
    every = groups.withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    out = every.join(got, [*keys, "kind"], "left").fillna(0, ["signals"]).join(F.broadcast(total))  # a row of counts
    out = out.withColumns({"coverage": F.coalesce(F.col("signals") / F.nullif("n", F.lit(0)), F.lit(0.0)), "per_day": F.col("signals") / F.nullif("days", F.lit(0))})
    return out.drop("n", "days")


def _total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_distinct(idiv("event_time_ns", DAY)).alias("days"))


def thresholds(rows: DataFrame, levels: list[float], cost: float, label_at: float) -> DataFrame:
    """`signal_stats` for each threshold. A row is a signal if the side that it is predicted for
    (a class more likely than no trade) has at least that probability.

    rows: event_time_ns, y, predicted, p_long, p_short, future_return. Each row is counted once
    for each level that it passes.
    """
    at = F.array(*(F.lit(float(x)) for x in levels))
    p = F.when(F.col("predicted") == LONG, F.col("p_long")).when(F.col("predicted") == SHORT, F.col("p_short"))
    r = rows.withColumn("threshold", F.explode(F.filter(at, lambda t: p >= t))).withColumn("side", F.col("predicted"))
    groups = rows.sparkSession.createDataFrame([(float(x),) for x in levels], "threshold double")
    return signal_stats(r, ["threshold"], _total(rows), groups, label_at, cost)


def best_threshold(stats: DataFrame, by: str = "precision", least: int = 100) -> DataFrame:
    """The row of both sides with the highest `by` among those with enough signals (of ties the
    lowest threshold)."""
    ok = stats.where((F.col("kind") == "both") & (F.col("signals") >= least) & F.col(by).isNotNull())
    return ok.orderBy(F.desc(by), "threshold").limit(1)


def with_confidence(rows: DataFrame) -> DataFrame:
    """rows with `confidence`: the probability of the side that is predicted, -1 for no trade."""
    return rows.withColumn("confidence", F.when(F.col("predicted") == LONG, F.col("p_long")).when(F.col("predicted") == SHORT, F.col("p_short")).otherwise(-1.0))


def top_share(rows: DataFrame, share: float, tie: str = "row_id") -> DataFrame:
    """The signals of highest confidence: that share of all rows, without those predicted as no
    trade. A threshold comes from exact counts of values, then the first rows of the step it cuts,
    ties by id. No task orders the table or that step.
    Rows are counted, and the step written, when this is called."""
    r = with_confidence(rows)
    want = int(r.count() * share + 1e-9)
    r = r.where(F.col("confidence") >= 0).withColumn("v_", F.floor(F.col("confidence") * 4096))
    line = Window.partitionBy(F.lit(0)).orderBy(F.desc("v_"))
    # values in steps first, so that the table that is summed in one task stays small
    cut = r.groupBy("v_").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(line)).where(F.col("upto") - F.col("k") < want)
    edge = cut.agg(F.min("v_").alias("v"), F.coalesce(F.max(F.col("upto") - F.col("k")), F.lit(0)).alias("above")).first()
    if edge["v"] is None or want == 0:
        return r.drop("v_").limit(0)
    last = scan.first_rows(r.where(F.col("v_") == edge["v"]), [F.desc("confidence"), F.col(tie)], want - edge["above"])
    return r.where(F.col("v_") > edge["v"]).unionByName(last).drop("v_")


def top_stats(rows: DataFrame, shares: list[float], cost: float, label_at: float) -> DataFrame:
    """`signal_stats` of the most confident signals for each share, with the least confidence
    among them (null if there are none). Rows are written when this is called."""
    rows = scan.settled(rows)  # every share counts and reads it
    chosen = [top_share(rows, x).withColumn("share", F.lit(float(x))) for x in shares]
    r = reduce(DataFrame.unionByName, chosen).withColumn("side", F.col("predicted"))
    groups = rows.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    floors = groups.join(r.groupBy("share").agg(F.min("confidence").alias("confidence_floor")), "share", "left")
    return signal_stats(r, ["share"], _total(rows), groups, label_at, cost).join(floors, "share")


#: What a model must reach to beat another: precision, and return of a signal.
LEAST_PRECISION, LEAST_RETURN = 0.5, 0.0015


def compare(base: DataFrame, other: DataFrame, least: int = 100) -> DataFrame:
    """Two models' `thresholds` at their best levels (by return net of cost) side by side. The
    other beats the base if its precision and its return are high enough and it has more signals
    a day. A model without enough signals has nulls and loses."""
    columns = ("threshold", "signals", "precision", "avg_return", "per_day")
    one = base.sparkSession.range(1).select(F.lit(1).alias("k_"))
    for name, stats in (("base", base), ("other", other)):
        best = best_threshold(stats, "net_of_cost", least)
        one = one.join(best.select(F.lit(1).alias("k_"), *(F.col(c).alias(f"{name}_{c}") for c in columns)), "k_", "left")
    beats = (F.col("other_precision") > LEAST_PRECISION) & (F.col("other_avg_return") > LEAST_RETURN) & (F.col("other_per_day") > F.coalesce("base_per_day", F.lit(0.0))) & F.col("base_threshold").isNotNull()
    return one.drop("k_").withColumn("beats", F.coalesce(beats, F.lit(False)))
