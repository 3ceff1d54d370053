"""Gradient boosting for several classes at once, by histograms.

Features are cut into bins at exact quantiles, once. A round grows one tree for each class, all of
them level by level in the same jobs: a task adds up gradients of the softmax loss by class, node,
feature and bin in numpy, Spark sums the cells of all tasks, and the driver, which sees cells
only (classes x nodes x features x bins, whatever the rows), picks the splits. Sums are whole
numbers, so the same rows give the same trees however they are spread. Boosting stops when the
loss of the validation rows, summed in the same jobs, has not improved for some rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import scan

#: Sums count in steps of this part of 1.
UNIT = 1 << 20


@dataclass
class Tree:
    """A tree of full depth as arrays: children of node i are 2i + 1 (bins up to the cut) and
    2i + 2; a node without a feature (-1) is a leaf, and so is the lowest level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after some levels (a leaf above them stays)."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[node]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Boosted:
    features: list[str]
    cuts: list[np.ndarray]
    base: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    splits: np.ndarray | None = None
    gains: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of values (rows x features): 0 for no value, then 1 and on."""
        out = np.empty(x.shape, np.uint8)
        for k, cuts in enumerate(self.cuts):
            out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(cuts, x[:, k], side="left"))
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.place(bins, self.depth)]
        return out

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        s = self.scores(bins)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _matrix(b: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]) if b.num_rows else np.zeros((0, len(features)))


def _binned(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r.tobytes() for r in model.bins(_matrix(b, model.features))]
        yield pa.RecordBatch.from_arrays([b.column("y_"), b.column("valid_"), pa.array(rows, pa.binary())], ["y_", "valid_", "bins_"])


def _cells(batches: Iterator[pa.RecordBatch], model: Boosted, grown: list[Tree], level: int, weight: np.ndarray, n_bins: int) -> Iterator[pa.RecordBatch]:
    """Sums of one task: cells of the level's nodes; cell -1 has the loss and count of validation rows."""
    classes, nodes, n_features = len(weight), 1 << level, len(model.features)
    sums = np.zeros((3, classes * nodes * n_features * n_bins), np.int64)
    loss, seen = 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        y, valid = b.column("y_").to_numpy(), b.column("valid_").to_numpy(zero_copy_only=False)
        bins = np.frombuffer(b"".join(b.column("bins_").to_pylist()), np.uint8).reshape(len(y), n_features)
        p = model.probabilities(bins)
        own = p[np.arange(len(y)), y]
        loss += int(np.rint(-np.log(np.maximum(own[valid], 1e-15)) * UNIT).astype(np.int64).sum())
        seen += int(valid.sum())
        bins, y, p = bins[~valid].astype(np.int64), y[~valid], p[~valid]
        w = weight[y]
        for k in range(classes):
            node = grown[k].place(bins, level) - (nodes - 1)
            here = node >= 0  # rows of a leaf above this level are done
            at = (((k * nodes + node[here])[:, None] * n_features + np.arange(n_features)) * n_bins + bins[here]).ravel()
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            for row, x in enumerate((g, h, np.ones(len(y)) / UNIT)):
                sums[row] += np.bincount(at, np.repeat(np.rint(x[here] * UNIT), n_features), sums.shape[1]).astype(np.int64)
    cell = np.flatnonzero(sums[2])
    columns = np.concatenate((cell, [-1])), *(np.append(s[cell], x) for s, x in zip(sums, (loss, 0, seen)))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "g", "h", "n"])


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best split of a node (features x bins); of
    equal gains the first. No split gives a gain of 0."""
    left = [np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n)]
    right = [x.sum(axis=1, keepdims=True) - a for x, a in zip((g, h, n), left)]
    part = lambda a, b: a * a / (b + l2)
    gain = part(left[0], left[1]) + part(right[0], right[1]) - part(g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True))
    gain = np.where((left[2] >= least) & (right[2] >= least), np.round(gain, 9), 0.0)
    best = int(gain.argmax())
    return float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]


def fit(train: DataFrame, features: list[str], label: str = "label_code", valid: DataFrame | None = None, classes: int = 3, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5, l2: float = 1.0, patience: int = 5, balanced: bool = True) -> Boosted:
    """Boosted trees on train; with valid, the rounds up to the least loss on it.

    Labels are 0 to classes - 1; rows with another or no label count for nothing. A null or NaN
    feature goes with the lowest values. With `balanced` every class weighs the same. No rows give
    a model without trees. Jobs run when this is called: one for each level of a round.
    """
    pick = lambda df, v: df.where(F.col(label).between(0, classes - 1)).select(F.col(label).cast("int").alias("y_"), F.lit(v).alias("valid_"), *(F.col(f).cast("double").alias(f) for f in features))
    rows = pick(train, False)
    melted = rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f).alias("x")) for k, f in enumerate(features))))).where("not isnan(x)")
    points = {f"q{i}": i / bins for i in range(1, bins)}
    found = {r["k"]: sorted({r[q] for q in points} - {None}) for r in scan.quantiles(melted, ["k"], "x", points).collect()}
    counts = np.zeros(classes)
    for r in rows.groupBy("y_").count().collect():
        counts[r["y_"]] = r["count"]
    total, held = counts.sum(), max(1, int((counts > 0).sum()))
    weight = np.where(counts > 0, total / (held * np.maximum(counts, 1)) if balanced else 1.0, 0.0)
    share = weight * counts / max((weight * counts).sum(), 1e-300)
    model = Boosted(list(features), [np.array(found.get(k, []), float) for k in range(len(features))], np.log(np.maximum(share, 1e-3)), depth, splits=np.zeros(len(features), np.int64), gains=np.zeros(len(features)))
    if not total:
        return model
    both = rows if valid is None else rows.unionByName(pick(valid, True))
    data = scan.settled(both.mapInArrow(lambda it: _binned(it, model), "y_ int, valid_ boolean, bins_ binary"))
    n_bins, best = bins + 1, 0
    for _ in range(rounds + (valid is not None)):  # one more for the loss of the last
        grown = [Tree.empty(depth) for _ in range(classes)]
        for level in range(depth):
            nodes = 1 << level
            sums = np.zeros((3, classes, nodes, len(features), n_bins))
            made = data.mapInArrow(_job(model, grown, level, weight, n_bins), "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
            cell = made.column("cell").to_numpy()
            if level == 0 and valid is not None:
                loss, n = (made.column(c).to_numpy()[cell < 0].sum() for c in ("g", "n"))
                model.losses.append(loss / UNIT / max(1, n))
                best = min(range(len(model.losses)), key=model.losses.__getitem__)
                if len(model.losses) > rounds or len(model.losses) - 1 - best >= patience:
                    model.rounds = model.rounds[:best]
                    return model
            for row, (c, unit) in enumerate((("g", UNIT), ("h", UNIT), ("n", 1))):
                sums[row].flat[cell[cell >= 0]] = made.column(c).to_numpy()[cell >= 0] / unit
            for k in range(classes):
                for node in range(nodes):
                    g, h, n = sums[:, k, node]
                    at, tree = nodes - 1 + node, grown[k]
                    gain, f, last = _split(g, h, n, l2, least)
                    if gain > 0:
                        tree.feature[at], tree.cut[at] = f, last
                        model.splits[f] += 1
                        model.gains[f] += gain
                        sides = (slice(0, last + 1), slice(last + 1, None))
                    else:
                        sides = ()
                    tree.value[at] = -rate * g[0].sum() / (h[0].sum() + l2)
                    for side, bin_range in enumerate(sides):
                        tree.value[2 * at + 1 + side] = -rate * g[f, bin_range].sum() / (h[f, bin_range].sum() + l2)
        model.rounds.append(grown)
    return model


def _job(*args) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _cells(batches, *args)


NAMES = ("p_notrade", "p_long", "p_short")


def predict(df: DataFrame, model: Boosted, names: tuple[str, ...] = NAMES) -> DataFrame:
    """df with a probability for each class."""

    @F.pandas_udf("array<double>")
    def p(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(list(model.probabilities(model.bins(x))))

    return df.withColumn("p_", p(*(F.col(f).cast("double") for f in model.features))).withColumns({n: F.col("p_")[k] for k, n in enumerate(names)}).drop("p_")


def importances(df_spark, model: Boosted) -> DataFrame:
    """Splits and gain of each feature."""
    rows = [(f, int(n), float(g)) for f, n, g in zip(model.features, model.splits, model.gains)]
    return df_spark.createDataFrame(rows, "feature string, splits long, gain double")
