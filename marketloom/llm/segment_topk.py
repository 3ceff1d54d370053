"""Exact top-k search with multi-resolution segment statistics.

A vector of n components is summarised at several resolutions by the mean and deviation of each
of its segments. Within a segment of length L two vectors have an inner product of at most
L (m m' + s s'), which bounds their distance from below and their inner product from above. The
finest resolutions have single components for most of the vector and one segment for the rest. Each tile of queries and candidates is tried coarse to fine: pairs whose bound cannot reach
the k-th score of their query drop out, and only survivors get exact integer products.

Queries and candidates are dealt into blocks of bounded size, and a tile is one block of each:
the stated query set meets all rows in blocks, whatever their number. Equal vectors are searched
once, under their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.work import cut, offsets, slim

K, EVERY, SCALE = 5, 50, 256
#: Equal segments of the coarse resolutions; the finest one follows from the length.
RESOLUTIONS = (4, 16)
#: The finest resolutions: single components, and one segment for the last such part.
FINE = (4, 8)
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 65_536
#: Scores beyond a long are given as the nearest long.
LEAST, MOST = -(2**63), 2**63 - 1
#: How whole numbers are stored: as the first kind that holds all of a vector's components.
KINDS = {b"h": ("<i2", 2.0**15), b"i": ("<i4", 2.0**31), b"d": ("<f8", np.inf)}


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.asarray(b.column("embedding").is_valid()) & np.asarray(b.column("vec_id").is_valid())
        b = b.filter(pa.array(keep))
        column = b.column("embedding")
        values = column.flatten()
        at = offsets(np.asarray(column.value_lengths()).astype(np.int64))
        with np.errstate(over="ignore"):
            x = np.floor(values.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE) + 0.0
        bad = ~np.isfinite(x)
        broken = np.concatenate(([0], np.cumsum(bad)))
        ok = broken[at[1:]] == broken[at[:-1]]
        rows = []
        for i, j in zip(at[:-1][ok], at[1:][ok]):
            largest = np.abs(x[i:j]).max(initial=0)
            kind = next(k for k, (_, bound) in KINDS.items() if largest < bound)
            rows.append(kind + x[i:j].astype(KINDS[kind][0]).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(ok)), pa.array(rows, pa.binary())], ["vec_id", "v"])


def statistics(x: np.ndarray, segments: int | list[int]) -> np.ndarray:
    """Rows whose inner products are the upper bounds: root-length-weighted means, deviations.

    segments: the number of equal segments, or where segments begin.
    """
    n = x.shape[1]
    bounds = sorted({n * k // segments for k in range(segments)}) if isinstance(segments, int) else segments
    lengths = np.diff([*bounds, n]).astype(float)
    mean = np.add.reduceat(x, bounds, axis=1) / lengths
    square = np.add.reduceat(x * x, bounds, axis=1) / lengths
    spread = np.sqrt(np.maximum(0, square - mean * mean))
    wide = lengths > 1  # a single component has no deviation
    return np.concatenate((mean * np.sqrt(lengths), (spread * np.sqrt(lengths))[:, wide]), 1)


def fine_segments(width: int, part: int) -> list[int]:
    """Beginnings of single components, then of one segment for the last `part`-th of a vector."""
    return list(range(max(1, width - max(1, width // part) + 1)))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of whole numbers, within a long."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if size < 2**53:
        return np.einsum("nd,nd->n", q, x).astype(np.int64)
    if size < 2**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2**62:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(1)
    whole = (sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q.tolist(), x.tolist()))
    return np.array([min(max(v, LEAST), MOST) for v in whole], np.int64)


def tile_topk(q: np.ndarray, x: np.ndarray, k: int, resolutions=RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, candidate row and score of pairs that may be among the k best, and how many
    exact products were needed. Rows are whole numbers as doubles."""
    width = max(q.shape[1], 1)
    out, exact = [], 0
    # bounds work on rows scaled by powers of 2, so that nothing overflows
    down = lambda m: np.ldexp(m, -int(np.frexp(np.abs(m).max(initial=0) or 1.0)[1]))
    qf, xf = down(q), down(x)
    steps = [*(s for s in resolutions if s < width), *(fine_segments(width, part) for part in FINE)]
    fine = [(statistics(qf, s), statistics(xf, s)) for s in steps]
    longest = np.sqrt((xf * xf).sum(1).max(initial=0))
    n = min(len(x), 4 * k)
    for start in range(0, len(q), 512):
        rows = slice(start, start + 512)
        some = qf[rows]
        slack = 1e-9 * (1e-300 + np.sqrt((some * some).sum(1)) * longest)
        alive = np.ones((len(some), len(x)), bool)
        floor = np.full(len(some), -np.inf)
        for a, b in fine:
            if alive.mean() > 0.05:
                up = np.where(alive, a[rows] @ b.T, -np.inf)
            else:
                i, j = np.nonzero(alive)
                up = np.full(alive.shape, -np.inf)
                for t in range(0, len(i), 65536):
                    u, v = i[t : t + 65536], j[t : t + 65536]
                    up[u, v] = np.einsum("nd,nd->n", a[rows][u], b[v])
            # the candidates with the best bounds raise the floor of the k-th score
            lead = np.argpartition(-up, n - 1, axis=1)[:, :n]
            found = np.einsum("qd,qcd->qc", some, xf[lead])
            found[~np.take_along_axis(alive, lead, 1)] = -np.inf
            if n >= k:
                floor = np.maximum(floor, np.partition(found, n - k, axis=1)[:, n - k])
            alive &= up >= (floor - slack)[:, None]
        i, j = np.nonzero(alive)
        exact += len(i)
        parts = [exact_products(q[rows][i[t : t + 65536]], x[j[t : t + 65536]]) for t in range(0, len(i), 65536)]
        score = np.concatenate(parts or [np.zeros(0, np.int64)])
        # no more than k for each query, but all ties of the k-th
        order = np.lexsort((-score.astype(object) if (score == LEAST).any() else -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(some)))
        last = np.minimum(first[i] + k - 1, len(i) - 1)
        kth = np.where(i[last] == i, score[last], LEAST) if len(i) else score
        ok = score >= kth
        out.append((i[ok] + start, j[ok], score[ok]))
    return (*(np.concatenate(c) for c in zip(*out)), exact) if out else (np.zeros(0, int),) * 3 + (0,)


def _matrix(rows: list[bytes]) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter rows are filled with zeros."""
    kinds = [r[:1] for r in rows]
    width = max(((len(r) - 1) // np.dtype(KINDS[k][0]).itemsize for r, k in zip(rows, kinds)), default=0)
    out = np.zeros((len(rows), width))
    for kind in set(kinds):
        size = np.dtype(KINDS[kind][0]).itemsize * width
        at = [k for k, x in enumerate(kinds) if x == kind]
        out[at] = np.frombuffer(b"".join(rows[k][1:].ljust(size, b"\0") for k in at), KINDS[kind][0]).reshape(len(at), width)
    return out


def _tile(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    q, x = _matrix(left["v"].tolist()), _matrix(right["v"].tolist())
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    ids = right["ids"].tolist()
    # one candidate more than k, as a query's own vector is among them
    i, j, score, _ = tile_topk(q, x, k + 1)
    queries = left["vec_id"].to_numpy()
    rows = [(queries[a], c, s) for a, b, s in zip(i, j, score) for c in ids[b] if c != queries[a]]
    found = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products.

    Queries are the rows whose vec_id is divisible by `every`. Rows with a null vec_id, a null
    vector or a null or non-finite component (also once scaled) take no part; shorter vectors
    count as filled with zeros; a score beyond a long is given, and ordered, as the nearest long;
    repeated rows of one vec_id with one vector count
    once; other columns are not read. No queries or no candidates give no rows.
    """
    rows = slim(embeddings, "vec_id", "embedding").mapInArrow(_scaled, "vec_id long, v binary")
    # the k + 1 smallest ids of each vector are all that can be reported of its copies
    first = Window.partitionBy("v").orderBy("vec_id")
    once = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    index = cut(once.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    asked = cut(rows.where(F.col("vec_id") % every == 0).distinct(), "queries")
    n, m = index.count(), asked.count()
    x_blocks, q_blocks = max(1, -(-n // min(candidates, max(256, n // 32)))), max(1, -(-m // queries))
    block = lambda blocks, *of: F.pmod(F.xxhash64(*of), F.lit(blocks)).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.withColumn("qb", block(q_blocks, "vec_id")).withColumn("xb", every_block(x_blocks))
    right = index.withColumn("xb", block(x_blocks, "v")).withColumn("qb", every_block(q_blocks))
    tiles = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb"))
    found = tiles.applyInPandas(lambda a, b: _tile(a, b, k), "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
