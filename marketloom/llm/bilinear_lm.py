"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The model sees two words back: the vector expected next is c1 * r(w-1) + c2 * r(w-2), and a
word's logit is its product with the word's output vector, plus a bias. Its vocabulary is the
most frequent words of the training fold and a class for each hash of a word ending, for all
other words; within a class a word has its smoothed share of the class. As a logit is a sum of
one term for each word back, the normaliser of every pair of words back is an entry of one matrix
product, and a token's normalised log-probability is three table look-ups.

Counts, statistics and training cover the whole training fold. Words are counted by partial sums;
texts become ids once, with the words outside a bounded frequent list beside them; each task
trains from a common start on all its rows, and parameters are averaged by tokens in two levels.
Scores of frequent words need no join; only the rare words of each text meet the counts in a join,
where no key is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.work import cut, offsets, sample, slim, texts

#: Words counted before a task hands its partial counts on.
HELD = 400_000
#: Words whose counts travel with the tasks, words of the model, and classes of other words.
FREQUENT, WORDS, CLASSES = 100_000, 1534, 512
#: Components of word vectors, tokens of a training step, noise words shared by a step.
RANK, STEP, NOISE = 24, 2048, 64
RATE = 0.1
#: Texts and tokens that the common start is trained on, at most; longer texts than that are left out there.
WARM_TEXTS, WARM_TOKENS = 3000, 2_000_000
END, START = WORDS + CLASSES, WORDS + CLASSES + 1
SIZE = WORDS + CLASSES + 2


def held_out(doc_id):
    """Remainder 1 of the crc32 of doc_id as text, modulo 5; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for b in batches:
        for t in texts(b.column("text")):
            seen.update((t or b"").lower().split())
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


class Vocabulary:
    """Frequent words with counts, their place in the model, and totals of the whole fold."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int, ends: int, classes: np.ndarray):
        frequent.sort(key=lambda x: (-x[1], x[0]))
        self.ids = {w: k for k, (w, _) in enumerate(frequent)}
        self.n, self.ends, self.base = n, ends, n + 0.5 * (v + 1)
        counts = np.array([c for _, c in frequent], float)
        kinds = np.array([word_class(w) for w, _ in frequent], np.int64)
        own = np.arange(len(frequent)) < WORDS
        self.base_of = np.log10((counts + 0.5) / self.base)
        self.end_base = float(np.log10((ends + 0.5) / self.base))
        # class totals (tokens, distinct words) without the words that the model has itself
        self.class_n, self.class_v = classes[:, 0].copy(), classes[:, 1].copy()
        np.subtract.at(self.class_n, kinds[own], counts[own])
        np.subtract.at(self.class_v, kinds[own], 1)
        self.class_base = self.class_n + 0.5 * (self.class_v + 1)
        self.share_of = np.where(own, 0.0, np.log10((counts + 0.5) / self.class_base[kinds]))
        # id -> model id: frequent words first, then classes of rare words
        self.model_of = np.concatenate((np.where(own, np.arange(len(frequent)), WORDS + kinds), WORDS + np.arange(CLASSES))).astype(np.int64)
        self.frequent = len(frequent)
        unigram = np.full(SIZE, 0.5)
        unigram[: min(WORDS, len(frequent))] += counts[:WORDS]
        unigram[WORDS : WORDS + CLASSES] += self.class_n
        unigram[END] += ends
        self.unigram = unigram / unigram.sum()


_ENCODED = "doc_id long, held_out boolean, row long, n_tokens long, ids binary, rare array<struct<word:binary,times:long>>"


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    vocabulary, row = shared.value, TaskContext.get().partitionId() << 40
    get, f = vocabulary.ids.get, vocabulary.frequent
    kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    for whole in batches:
        for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            ids, rare, n = [], [], []
            for t in texts(b.column("text")):
                words = (t or b"").lower().split()
                found = list(map(get, words))
                other: list[bytes] = []
                if None in found:
                    for k, x in enumerate(found):
                        if x is None:
                            other.append(words[k])
                            found[k] = f + word_class(words[k])
                ids.append(np.array(found, "<i4").tobytes())
                rare.append([{"word": w, "times": c} for w, c in Counter(other).items()])
                n.append(len(words) + 1)
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(rows), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, kind)],
                ["doc_id", "held_out", "row", "n_tokens", "ids", "rare"],
            )


# The model


class Model:
    def __init__(self, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.p = {
            "r": rng.normal(0, 0.1, (SIZE, RANK)).astype(np.float32),
            "q": rng.normal(0, 0.1, (SIZE, RANK)).astype(np.float32),
            "c": np.ones((2, RANK), np.float32) * np.float32(0.7),
            "b": np.log(unigram).astype(np.float32)[:, None],
        }
        self.g = {k: np.full_like(x, 1e-3) for k, x in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.p.values(), *self.g.values())])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for of in (self.p, self.g):
            for k, x in of.items():
                of[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return self

    def train(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps with AdaGrad; each step's words share their noise."""
        p = self.p
        cumulative = np.cumsum(self.unigram)
        log_noise = np.log(NOISE * self.unigram).astype(np.float32)
        for k in range(0, len(w), STEP):
            a, b, t = w1[k : k + STEP], w2[k : k + STEP], w[k : k + STEP]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), SIZE - 1)
            ra, rb, qt, qn = p["r"][a], p["r"][b], p["q"][t], p["q"][noise]
            context = ra * p["c"][0] + rb * p["c"][1]
            true = (context * qt).sum(1) + p["b"][t, 0] - log_noise[t]
            false = context @ qn.T + (p["b"][noise, 0] - log_noise[noise])
            gt = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            gf = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
            down = gt[:, None] * qt + gf @ qn
            self._step("c", np.arange(2), np.stack(((down * ra).sum(0), (down * rb).sum(0))), len(t))
            self._step("r", np.concatenate((a, b)), np.concatenate((down * p["c"][0], down * p["c"][1])), 1)
            self._step("q", np.concatenate((t, noise)), np.concatenate((gt[:, None] * context, gf.T @ context)), 1)
            self._step("b", np.concatenate((t, noise)), np.concatenate((gt, gf.sum(0)))[:, None], 1)

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray, scale: int) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        total = np.add.reduceat(gradient[order], first, axis=0) / np.float32(scale)
        rows, g, p = rows[first], self.g[name], self.p[name]
        g[rows] += total * total
        p[rows] -= np.float32(RATE) * total / np.sqrt(g[rows])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 terms of the words one and two back for every next word, and of the normaliser."""
        p = self.p
        one = (p["r"] * p["c"][0]) @ p["q"].T + p["b"].T
        two = (p["r"] * p["c"][1]) @ p["q"].T
        one[:, START] = -np.inf  # no word is followed by a start
        m1, m2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(one - m1) @ np.exp(two - m2).T, 1e-37)) + m1 + m2.T
        e = np.float32(np.log10(np.e))
        return one * e, two * e, norm * e


def _sequences(b: pa.RecordBatch, model_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words one and two back and the word, of all tokens of a batch; bounds; frequent-list ids."""
    raw = b.column("ids").to_pylist()
    lengths = np.array([len(x) // 4 for x in raw], np.int64)
    ids = np.frombuffer(b"".join(raw), "<i4")
    at = offsets(lengths + 1)
    w = np.full(at[-1], END)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    w[inside] = model_of[ids]
    w1, w2 = np.full(at[-1], START), np.full(at[-1], START)
    w1[1:], w2[2:] = w[:-1], w[:-2]
    w1[at[:-1]] = START
    w2[at[:-1]] = START
    second = at[:-1] + 1
    w2[second[second < at[1:]]] = START
    return w1, w2, w, at, ids


BLOCKS = 32


def _train(batches: Iterator[pa.RecordBatch], start: np.ndarray, shared) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    v = shared.value
    part = TaskContext.get().partitionId()
    model, rng, n = Model(v.unigram).load(start), np.random.default_rng(part), 0
    for whole in batches:
        for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            w1, w2, w, _, _ = _sequences(b, v.model_of)
            model.train(w1, w2, w, rng)
            n += len(w)
    if n:
        parts = np.array_split(model.flat(), BLOCKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([part % 64] * BLOCKS, pa.int32()), pa.array([float(n)] * BLOCKS), pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary())],
            ["block", "salt", "n", "values"],
        )


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total = pdf["n"].sum()
    mean = sum(np.frombuffer(v, "<f4").astype(float) * n for v, n in zip(pdf["values"], pdf["n"])) / total
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [total], "values": [mean.astype("<f4").tobytes()]})


_tables: dict[str, tuple] = {}


def _scores(batches: Iterator[pa.RecordBatch], flat: np.ndarray, shared) -> Iterator[pa.RecordBatch]:
    v = shared.value
    key = str(zlib.crc32(flat.tobytes()))
    if key not in _tables:  # once for each worker
        _tables.clear()
        _tables[key] = Model(v.unigram).load(flat).tables()
    one, two, norm = _tables[key]
    base_of = np.concatenate((v.base_of, np.zeros(CLASSES)))
    share_of = np.concatenate((v.share_of, np.zeros(CLASSES)))
    for whole in batches:
        for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            if not b.num_rows:
                continue
            w1, w2, w, at, ids = _sequences(b, v.model_of)
            token = (one[w1, w] + two[w2, w] - norm[w1, w2]).astype(float)
            inside = np.ones(len(w), bool)
            inside[at[1:] - 1] = False
            base, share = np.full(len(w), v.end_base), np.zeros(len(w))
            base[inside], share[inside] = base_of[ids], share_of[ids]
            known = np.full(len(w), v.ends > 0, np.int64)
            known[inside] = ids < v.frequent
            add = lambda x: pa.array(np.add.reduceat(x, at[:-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "row", "n_tokens")), add(known), add(base), add(token + share)], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score"])


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary, np.ndarray, object]:
    """Counts of training words, encoded texts, vocabulary, parameters and the shared vocabulary."""
    spark = docs.sparkSession
    docs = slim(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    training = docs.where("not held_out")
    counts = training.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    size = F.floor(F.log2("n") * 16).cast("int")
    ends = training.count()
    # the list holds every word at least as frequent as a bound that leaves it short enough
    steps = sorted(((r["s"], r["count"]) for r in counts.groupBy(size.alias("s")).count().collect()), reverse=True)
    total, bound = 0, 1 << 30
    for s, c in steps:
        if total + c > FREQUENT:
            break
        total, bound = total + c, s
    frequent = [(bytes(r["word"]), r["n"]) for r in counts.where(size >= bound).collect()]
    kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES)).cast("int")
    classes = np.zeros((CLASSES, 2))
    for r in counts.groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        classes[r["k"]] = r["n"], r["v"]
    n, v = classes.sum(0)
    vocabulary = Vocabulary(frequent, int(n) + ends, int(v) + (ends > 0), ends, classes)
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by FREQUENT
    encoded = cut(docs.mapInArrow(lambda it: _encode(it, shared), _ENCODED), "encoded")
    lines = encoded.where("not held_out")
    model = Model(vocabulary.unigram)
    chosen, room = [], WARM_TOKENS
    for r in sample(lines.select("row", "n_tokens"), ["row"], WARM_TEXTS).collect():
        if r["n_tokens"] <= room:
            chosen.append((r["row"],))
            room -= r["n_tokens"]
    chosen = spark.createDataFrame(chosen, "row long")  # bounded by WARM_TEXTS
    some = lines.join(F.broadcast(chosen), "row").orderBy("row").select("ids").toArrow().to_batches()
    rng = np.random.default_rng(0)
    for _ in range(2):  # a common start for all tasks
        for b in some:
            for piece in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                model.train(*_sequences(piece, vocabulary.model_of)[:3], rng)
    start = model.flat()
    trained = lines.select("ids").mapInArrow(lambda it: _train(it, start, shared), "block int, salt int, n double, values binary")
    kind = "block int, n double, values binary"
    means = trained.groupBy("block", "salt").applyInPandas(_average, kind).groupBy("block").applyInPandas(_average, kind)
    found = sorted((r["block"], bytes(r["values"])) for r in means.collect())  # one model
    flat = np.frombuffer(b"".join(x for _, x in found), "<f4") if found else start
    return counts, encoded, vocabulary, flat, shared


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is one end token; repeated rows are scored each; a null doc_id belongs
    to the training fold; other columns are not read; without training rows every word is unseen;
    an empty table gives no rows.
    """
    counts, encoded, v, flat, shared = fit(docs)
    common = encoded.select("doc_id", "held_out", "row", "n_tokens", "ids").mapInArrow(
        lambda it: _scores(it, flat, shared), "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double"
    )
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
    seen = rare.join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0)) + 0.5
    kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES)).cast("int")
    share = F.log10(c / F.element_at(F.array(*(F.lit(float(x)) for x in v.class_base)), kind + 1))
    extra = seen.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c / F.lit(v.base))).alias("base"),
        F.sum(F.col("times") * share).alias("share"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    zero = lambda name, x: (F.col(name) + F.coalesce(x, F.lit(0))).alias(name)
    return common.join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", zero("n_known", "known").cast("long").alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"), zero("base_score", "base").alias("base_score"), zero("score", "share").alias("score")
    )
