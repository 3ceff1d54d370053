"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score is logistic(b + w.x + sum of <v_i, v_j> x_i x_j), and the pairwise sum takes linear
time as half of |sum v_i x_i|^2 - sum |v_i x_i|^2. Words enter by a hash; structure (shares of
kinds of characters, word lengths, repeated lines) and the table's length column enter as a few
dense inputs. The machine is fitted on a bounded sample of labelled rows; every text is scored
whole in the task that reads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import work
from marketloom.llm.work import batch, ragged, slim, texts

#: Word buckets, rank of the interactions, and the most labelled rows to fit on.
BUCKETS, RANK, SAMPLE = 1 << 14, 8, 6000
EPOCHS, THRESHOLD = 12, 0.7

_upper, _lower, _digit, _space = range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (9, 10, 11, 12, 13, 32)
_kinds = np.zeros((256, 9))
for _k, _of in enumerate((_upper, _lower, _digit, _space, b".,;:", b"!?", b"%$&#*@^~|\\<>{}[]=_+", b"\n", range(0x80, 0x100))):
    _kinds[list(_of), _k] = 1
DENSE = 16


def inputs(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs; the last DENSE indices are structure."""
    text = text or b""
    words = text.split()
    dense = np.zeros(DENSE)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _kinds
    size = max(1, len(text))
    dense[:9] = 4 * counts / size
    n = len(words)
    lines = text.split(b"\n")
    dense[9] = np.log1p(len(text)) / 10
    dense[10] = np.log1p(max(0, n_chars or 0)) / 10
    dense[11] = np.log1p(n) / 10
    dense[12] = min(4.0, size / max(1, n) / 6)
    dense[13] = 1 - len(set(lines)) / len(lines)
    dense[14] = (counts[5] + counts[6]) / max(1, n)
    dense[15] = n == 0
    if n:
        found = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, n) & np.uint32(BUCKETS - 1))
        at = np.flatnonzero(found)
        value = np.log1p(found[at])
        value /= np.sqrt((value * value).sum())
    else:
        at, value = np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate((at, np.arange(BUCKETS, BUCKETS + DENSE))), np.concatenate((value, dense))


class Machine:
    def __init__(self, seed: int = 11):
        n = BUCKETS + DENSE
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, RANK))

    def scores(self, at: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of rows with the given inputs; every row has some."""
        vx = self.v[at] * value[:, None]
        total = np.add.reduceat(vx, bounds[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), bounds[:-1])
        z = self.bias + np.add.reduceat(self.w[at] * value, bounds[:-1]) + 0.5 * ((total * total).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        """AdaGrad on the logistic loss in small batches."""
        if not rows:
            return self
        y = np.array([r[2] for r in rows])
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(5)
        gb, gw, gv = 1.0, np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), 64):
                some = [rows[i] for i in order[k : k + 64]]
                at = np.concatenate([r[0] for r in some])
                value = np.concatenate([r[1] for r in some])
                lengths = np.array([len(r[0]) for r in some])
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                error = (self.scores(at, value, bounds) - np.array([r[2] for r in some])) / len(some)
                each = np.repeat(error, lengths) * value
                total = np.add.reduceat(self.v[at] * value[:, None], bounds[:-1], axis=0)
                dv = each[:, None] * (np.repeat(total, lengths, axis=0) - self.v[at] * value[:, None])
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, each) + decay * self.w[used]
                full = np.zeros((len(used), RANK))
                np.add.at(full, back, dv)
                full += decay * self.v[used]
                gb += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(gb)
                gw[used] += dw * dw
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                gv[used] += full * full
                self.v[used] -= rate * full / np.sqrt(gv[used])
        return self


_INPUTS = pa.schema([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [inputs(t, n) for t, n in zip(texts(b.column("text")), b.column("n_chars").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0].astype(np.int32) for m in made], _INPUTS[0].type), pa.array([m[1].astype(np.float32) for m in made], _INPUTS[1].type), b.column("y")],
            ["at", "value", "y"],
        )


def remainder(doc_id, modulus: int):
    """crc32 of the doc_id as text, modulo; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled rows outside the held-out fold, chosen by a
    hash of doc_id. Labels that are null or neither 0 nor 1 count for nothing; of several labels
    of one doc_id the smallest holds, and of several rows that with the least hash of its text."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), 4) != 2)
    chosen = work.sample(known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")), ["doc_id"], sample)
    rows = slim(docs, "doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", "y")
    one = F.struct(F.xxhash64("text").alias("hash"), "text", "n_chars", "y")
    rows = rows.groupBy("doc_id").agg(F.min(one).alias("row")).select("doc_id", "row.text", "row.n_chars", "row.y")
    made = rows.mapInArrow(_sparse, "at array<int>, value array<float>, y double").toArrow()
    at, bounds = ragged(made.column("at").combine_chunks())
    value = ragged(made.column("value").combine_chunks())[0].astype(float)
    y = made.column("y").to_numpy()
    data = [(at[i:j], value[i:j], float(t)) for i, j, t in zip(bounds, bounds[1:], y)]
    data.sort(key=lambda r: (r[2], len(r[0]), r[1].tobytes()))  # the same rows in any order give the same machine
    return Machine().fit(data)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = []
        found, counts = texts(b.column("text")), b.column("n_chars").to_pylist()
        for k in range(0, len(found), 64):
            made = [inputs(t, n) for t, n in zip(found[k : k + 64], counts[k : k + 64])]
            bounds = np.concatenate(([0], np.cumsum([len(m[0]) for m in made])))
            score.append(machine.scores(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), bounds))
        score = np.concatenate(score) if score else np.zeros(0)
        columns = {f.name: b.column(f.name) for f in b.schema if f.name not in ("text", "n_chars")}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*columns, "score", "predicted"])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts are scored by their (empty) structure; a null n_chars counts as 0;
    repeated rows get one answer each; without usable labels the score is 0.5; an empty table
    gives no rows; other columns are not read.
    """
    machine = fit(docs, labels)
    ready = slim(docs, "doc_id", "text", "n_chars").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return ready.select("doc_id", "held_out", "text", "n_chars").mapInArrow(lambda it: _score(it, machine), "doc_id long, held_out boolean, score double, predicted int")


def _keep(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slim_batch = b.select(["text", "n_chars"])
        for scored in _score(iter([slim_batch]), machine):
            yield b.filter(pa.array(scored.column("predicted").to_numpy() == 1))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, as they came."""
    machine = fit(docs, labels)
    return docs.mapInArrow(lambda it: _keep(it, machine), docs.schema)
