"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree cuts space by random hyperplanes at the median of a bounded sample, until a leaf is
expected to hold few rows of the whole table; all vectors are routed to one leaf of every tree. A
query walks all trees through one priority queue, always opening the branch whose nearest
hyperplane is least far, until it has its share of the leaves. Leaves and queries meet in a join
on the leaf, and candidates are ranked by exact cosine on the original vectors. Equal vectors are
indexed once; large leaves are split into parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import work
from marketloom.llm.work import cut, offsets, slim

K, EVERY = 5, 50
#: Trees, sampled vectors to fit them on, rows that a leaf should hold, sampled vectors in a leaf at
#: least, the share of leaves that a query opens, and rows of one part of a large leaf.
TREES, SAMPLE, ROWS, LEAF, OPENED, PART = 12, 32_768, 512, 8, 0.08, 4096
#: Queries that meet one part of a leaf at once, over all leaves.
QUERIES = 1 << 16


def _usable(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(pa.array(np.asarray(b.column("embedding").is_valid()) & np.asarray(b.column("vec_id").is_valid())))
        column = b.column("embedding")
        at = offsets(np.asarray(column.value_lengths()).astype(np.int64))
        x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        wrong, some = (np.concatenate(([0], np.cumsum(f))) for f in (~np.isfinite(x), np.isfinite(x) & (x != 0)))
        ok = (wrong[at[1:]] == wrong[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        x = x.astype(kind)
        rows = [x[i:j].tobytes() for i, j in zip(at[:-1][ok], at[1:][ok])]
        yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(ok)), pa.array(rows, pa.binary())], ["vec_id", "v"])


def matrix(rows: list[bytes], kind: str, width: int | None = None) -> np.ndarray:
    """Rows of doubles from rows of the given kind; shorter rows are filled with zeros."""
    size = np.dtype(kind).itemsize
    width = size * width if width else max((len(r) for r in rows), default=0)
    return np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), kind).reshape(len(rows), width // size).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Trees as arrays; leaf k is stored as child -k - 1."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        self.width = x.shape[1]
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(3)
        self.roots = [self._build(x, leaf) for _ in range(trees)]
        self.plane_of = np.array(self.planes or [np.zeros(self.width)])
        self.cut_of = np.array(self.cuts or [0.0])
        self.child_of = np.array(self.child or [[0, 0]])

    def _build(self, x: np.ndarray, leaf: int) -> int:
        if len(x) > leaf:
            a, b = x[self.rng.choice(len(x), 2, replace=False)]
            plane = a - b if np.abs(a - b).max(initial=0) > 1e-9 else self.rng.normal(size=self.width)
            plane = plane / np.sqrt((plane * plane).sum())
            side = x @ plane
            cut = float(np.median(side))
            low = side <= cut
            if low.any() and not low.all():
                k = len(self.child)
                self.planes.append(plane)
                self.cuts.append(cut)
                self.child.append([0, 0])
                self.child[k] = [self._build(x[low], leaf), self._build(x[~low], leaf)]
                return k
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in every tree (rows x trees)."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (node >= 0).any():
                at = np.flatnonzero(node >= 0)
                of = node[at]
                side = np.einsum("nd,nd->n", x[at], self.plane_of[of]) > self.cut_of[of]
                node[at] = self.child_of[of, side.astype(int)]
            out[:, t] = -node - 1
        return out

    def search(self, q: np.ndarray, opened: int) -> list[int]:
        """Leaves in the order of one priority queue over all trees."""
        # least violated margin first; a leaf is taken as soon as it leads the queue
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        side = self.plane_of @ q - self.cut_of
        found: list[int] = []
        while queue and len(found) < opened:
            far, node = heapq.heappop(queue)
            while node >= 0:
                s = side[node]
                own = int(s > 0)
                heapq.heappush(queue, (max(far, abs(s)), int(self.child_of[node, 1 - own])))
                node = int(self.child_of[node, own])
            found.append(-node - 1)
        return found


def _indexed(batches: Iterator[pa.RecordBatch], forest: Forest, parts: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rows = b.column("v").to_pylist()
        leaf = forest.place(unit(matrix(rows, kind, forest.width)))
        part = (np.arange(leaf.size).reshape(leaf.shape) // leaf.shape[1] * 7919 + b.num_rows) % parts[leaf]
        at = np.repeat(np.arange(len(rows)), leaf.shape[1])
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(part.ravel()), b.column("ids").take(take), b.column("v").take(take)], ["leaf", "part", "ids", "v"])


def _asked(batches: Iterator[pa.RecordBatch], forest: Forest, parts: np.ndarray, opened: int, kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rows = b.column("v").to_pylist()
        found = [forest.search(q, opened) for q in unit(matrix(rows, kind, forest.width))]
        at, leaf, part = zip(*((i, f, p) for i, leaves in enumerate(found) for f in leaves for p in range(parts[f])))
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(part, pa.int64()), b.column("vec_id").take(take), b.column("v").take(take)], ["leaf", "part", "query_id", "q"])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: squares and products
    then stay in the doubles, and no digit of the cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = scaled(q), scaled(x)
    return np.einsum("nd,nd->n", q, x) / (np.sqrt(np.einsum("nd,nd->n", q, q)) * np.sqrt(np.einsum("nd,nd->n", x, x)))


def _leaf(left: pd.DataFrame, right: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The k best candidates of one part of a leaf for each query that opened it."""
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    q, x = matrix(left["q"].tolist(), kind), matrix(right["v"].tolist(), kind)
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    queries, ids = left["query_id"].to_numpy(), right["ids"].tolist()
    n, near, pairs = min(len(x), k + 1), unit(x).T, []
    for start in range(0, len(q), 1024):
        rough = unit(q[start : start + 1024]) @ near
        kth = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n]
        pairs.append(np.argwhere(rough >= kth[:, None] - 1e-9) + (start, 0))
    i, j = np.concatenate(pairs).T
    score = cosine(q[i], x[j])
    rows = [(queries[a], c, s) for a, b, s in zip(i, j, score) for c in ids[b] if c != queries[a]]
    found = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, sample: int = SAMPLE, rows_of_leaf: int = ROWS, opened: float = OPENED, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found by cosine.

    Queries are the rows whose vec_id is divisible by `every`. Rows with a null vec_id, a null or
    zero vector, or a null or infinite component take no part; shorter vectors count as filled
    with zeros; repeated rows count once; other columns are not read. A query opens that share
    of all leaves, and two leaves for each tree at least; it has fewer than k rows only where these
    hold fewer others. No queries or no candidates give no rows.
    """
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    rows = slim(embeddings, "vec_id", "embedding").mapInArrow(lambda it: _usable(it, kind), "vec_id long, v binary")
    first = Window.partitionBy("v").orderBy("vec_id")
    once = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    index = cut(once.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    asked = cut(rows.where(F.col("vec_id") % every == 0).distinct(), "queries")
    fitted = [bytes(r["v"]) for r in work.sample(index.select("v"), ["v"], sample).collect()]
    leaf = max(LEAF, len(fitted) * rows_of_leaf // max(1, index.count()))
    forest = Forest(unit(matrix(fitted, kind)) if fitted else np.zeros((0, 1)), trees, leaf)
    one = np.ones(max(1, forest.leaves), np.int64)
    indexed = lambda parts: index.mapInArrow(lambda it: _indexed(it, forest, parts, kind), "leaf long, part long, ids array<long>, v binary")
    parts = one.copy()
    for r in indexed(one).groupBy("leaf").count().collect():  # at most as many as leaves
        parts[r["leaf"]] = -(-r["count"] // part)
    wanted = max(2 * trees, int(np.ceil(opened * forest.leaves)))
    spread = max(8, embeddings.sparkSession.sparkContext.defaultParallelism)
    left = asked.repartition(spread, "vec_id").mapInArrow(lambda it: _asked(it, forest, parts, wanted, kind), "leaf long, part long, query_id long, q binary")
    blocks = max(1, -(-asked.count() // QUERIES))
    left = left.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = indexed(parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["leaf", "part", "block"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(lambda a, b: _leaf(a, b, k, kind), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
