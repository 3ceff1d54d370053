"""Near-duplicate documents: SimHash fingerprints joined exactly through vantage-point trees.

Fingerprints at most k bits apart agree within floor(k / m) bits on at least one of m bit blocks.
For each block a vantage-point tree is fitted on a bounded sample: a node holds a vantage value
and a median Hamming distance, and its two sides are the values nearer and farther. The number of
leaves grows with the fingerprints. Every fingerprint is routed to the leaf that it belongs to
and, as a visitor, to each leaf that the triangle bound cannot rule out for its radius, so that
pairs across a boundary meet. By default there are five blocks, so that the radius is 0 and pairs
come from blocks that agree: at radius 1 (three blocks) a row visits three times as many leaves
in a table five times as large, which no cluster makes up for.

Only distinct fingerprints are compared, and a leaf gives a spanning star of each of its local
components in place of all its pairs, so output stays linear in the input. Leaves larger than a
tile are dealt out as pairs of parts. Links between stars are closed by repeated joins.

Texts of a given similarity (`one_of_each`) are searched with wider fingerprints, and texts whose
fingerprints link only say which texts to compare: exact Jaccard similarity decides inside each
component of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import work
from marketloom.llm.work import batch, cut, slim, texts

WORDS, SEED, MAX_BITS, BLOCKS = 4, 42, 4, 5
#: Fingerprints that the trees are fitted on, sampled values in a leaf at which splitting ends at
#: the latest, rows that a leaf is meant to own, and rows of a part of a larger leaf.
SAMPLE, LEAF, OWN, TILE = 65_536, 4, 128, 4096
#: For similar texts: words of a shingle, least Jaccard similarity of shingle sets, words of a
#: fingerprint, blocks of each word, words that are compared, and bits in which these may differ.
#: A bit differs with probability 0.15 at similarity 0.8, so that about one pair in 9,000 agrees on
#: none of 48 blocks, and one in 20,000 differs in more than 62 of 256 bits.
SIMILAR = {"words": 5, "least": 0.8, "width": 8, "blocks": 6, "compared": 4, "max_bits": 62}
#: Texts and shingles that one task compares with each other.
TEXTS, SHINGLES = 1024, 1 << 20
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def names(width: int) -> list[str]:
    """Columns of a fingerprint of `width` 64-bit words."""
    return ["fp", *(f"fp{k}" for k in range(1, width))]


def _prints_schema(width: int) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names(width))])


def _routed_schema(width: int) -> pa.Schema:
    """Rows in tiles, with the words that are compared."""
    whole = [(c, pa.int32()) for c in ("block", "leaf", "i", "j", "side")]
    return pa.schema([*whole, ("home", pa.bool_()), *((c, pa.int64()) for c in names(width)), ("node", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


# Fingerprints


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of a shingle from its first one (k = 0: itself)."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h = h ^ h >> np.uint64(31)
    return h


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, in order; a text of fewer words is one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[:n], ends[min(words, len(found)) - 1 :])), repeat(SEED))
    return np.fromiter(hashes, np.uint64, n)


def fingerprints(text: bytes | None, words: int = WORDS, width: int = 1) -> list[int]:
    """SimHash of a text's word shingles in 64-bit words; a text without words has zeros."""
    return simhash(shingles(text, words), width)


def simhash(h: np.ndarray, width: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half the hashes; further words hash the hashes."""
    n = len(h)
    if not n:
        return [0] * width
    out = []
    for w in range(width):
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 8192):
            part = np.ascontiguousarray(_mixed(h[k : k + 8192], w))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    return fingerprints(text, words)[0]


def _prints(batches: Iterator[pa.RecordBatch], words: int, width: int) -> Iterator[pa.RecordBatch]:
    schema = _prints_schema(width)
    for b in batches:
        fp = np.array([fingerprints(t, words, width) for t in texts(b.column("text"))], np.uint64).reshape(-1, width).view(np.int64)
        yield batch({"doc_id": b.column("doc_id")} | {c: fp[:, k] for k, c in enumerate(names(width))}, schema)


# Vantage-point trees


class Tree:
    """A vantage-point tree of one bit block, as arrays; leaf k is left or right value -k - 1."""

    def __init__(self, values: np.ndarray, shift: int, bits: int, leaf: int = LEAF):
        self.shift, self.mask = np.uint64(shift), np.uint64((1 << bits) - 1)
        self.vantage: list[int] = []
        self.median: list[int] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(bits + shift)
        self.root = self._build(np.unique(self.block(values)), leaf)
        self.vantage_of = np.array(self.vantage or [0], np.uint64)
        self.median_of = np.array(self.median or [0], np.int64)
        self.child_of = np.array(self.child or [[0, 0]], np.int64)

    def block(self, fp: np.ndarray) -> np.ndarray:
        return fp >> self.shift & self.mask

    def _build(self, values: np.ndarray, leaf: int) -> int:
        if len(values) > leaf:
            best = None
            for v in self.rng.choice(values, 4 if len(values) > 256 else 1, replace=False):
                d = np.bitwise_count(values ^ v)
                m = int(np.median(d))
                m -= bool((d <= m).all())
                even = abs(int((d <= m).sum()) * 2 - len(values))
                if best is None or even < best[0]:
                    best = even, v, m, d <= m
            _, v, m, near = best
            if near.any() and not near.all():
                k = len(self.vantage)
                self.vantage.append(int(v))
                self.median.append(m)
                self.child.append([0, 0])
                self.child[k] = [self._build(values[near], leaf), self._build(values[~near], leaf)]
                return k
        self.leaves += 1
        return -self.leaves

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether the row belongs there, for each leaf that the radius reaches."""
        x = self.block(fp)
        row, node, home = np.arange(len(x)), np.full(len(x), self.root), np.ones(len(x), bool)
        out = []
        while len(row):
            done = node < 0
            if done.any():
                out.append((row[done], -node[done] - 1, home[done]))
                row, node, home = row[~done], node[~done], home[~done]
                continue
            d = np.bitwise_count(x[row] ^ self.vantage_of[node]).astype(np.int64)
            own = d > self.median_of[node]  # 0: the near side
            far = np.where(own, d - radius <= self.median_of[node], d + radius > self.median_of[node])
            row, node, home = (
                np.concatenate((row, row[far])),
                np.concatenate((self.child_of[node, own.astype(int)], self.child_of[node, 1 - own.astype(int)][far])),
                np.concatenate((home, np.zeros(int(far.sum()), bool))),
            )
        if not out:
            out = [(row, node, home)]
        return tuple(np.concatenate(x) for x in zip(*out))


def forest(values: np.ndarray, blocks: int, leaf: int = LEAF) -> list[Tree]:
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    return [Tree(values, a, b - a, leaf) for a, b in zip(bounds, bounds[1:])]


def _matrix(b, width: int) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in names(width)], 1).view(np.uint64)


def _route(batches: Iterator[pa.RecordBatch], trees: list[Tree], radius: int, parts: dict, width: int, compared: int) -> Iterator[pa.RecordBatch]:
    schema, each = _routed_schema(compared), len(trees) // width
    for whole_batch in batches:
        for b in (whole_batch.slice(i, 2048) for i in range(0, whole_batch.num_rows, 2048)):
            fp = _matrix(b, width)
            node = b.column("node").to_numpy()
            for k, tree in enumerate(trees):
                row, leaf, home = tree.route(fp[:, k // each], radius)
                many = parts.get(k)
                n = np.ones(len(row), np.int64) if many is None else many[leaf]
                own = (fp[row, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                at = np.repeat(np.arange(len(row)), n)  # a part meets each part of its leaf, itself too
                other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                i, j = np.minimum(own[at], other), np.maximum(own[at], other)
                whole = {"block": np.full(len(at), k), "leaf": leaf[at], "i": i, "j": j, "side": own[at]}
                bits = fp[row][at].view(np.int64)
                yield batch({c: x.astype(np.int32) for c, x in whole.items()} | {"home": home[at], "node": node[row][at]} | {c: bits[:, w] for w, c in enumerate(names(compared))}, schema)


def stars(fp: np.ndarray, side: np.ndarray, home: np.ndarray, cross: bool, max_bits: int) -> list[tuple[int, int]]:
    """Centre and member of each component among rows (of 64-bit words) at most max_bits apart."""

    words = fp.shape[1]
    # the first word alone rules most pairs out: its share of the bits and six deviations
    first = max_bits if words == 1 else min(max_bits, int(max_bits / words + 6 * (max_bits / words) ** 0.5))

    def near(a, b):
        ok = np.bitwise_count(fp[a, 0][:, None] ^ fp[b, 0][None, :]) <= first
        ok &= home[a][:, None] | home[b][None, :]
        if cross:
            ok &= side[a][:, None] != side[b][None, :]
        if words > 1:
            x, y = np.nonzero(ok)
            apart = np.zeros(len(x), np.uint16)
            for w in range(words):
                apart += np.bitwise_count(fp[a[x], w] ^ fp[b[y], w])
            ok[x, y] = apart <= max_bits
        return ok

    everything = np.arange(len(fp))
    linked = np.zeros(len(fp), bool)
    for k in range(0, len(fp), 512):
        a = everything[k : k + 512]
        linked[a] = near(a, everything).sum(1) > (0 if cross else home[a])
    left, out = np.flatnonzero(linked), []
    while len(left):
        centre, left = left[0], left[1:]
        queue = np.array([centre])
        while len(queue) and len(left):
            some, queue = queue[:64], queue[64:]
            hit = near(some, left).any(0)
            out += [(centre, x) for x in left[hit]]
            queue, left = np.concatenate((queue, left[hit])), left[~hit]
    return out


def _link(batches: Iterator[pa.RecordBatch], max_bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Stars of each tile; rows come sorted by tile, and a tile may span batches."""
    kept: list[pa.RecordBatch] = []

    def close(table):
        t = {c: table.column(c).to_numpy() for c in ("i", "j", "side", "home", "node")}
        pairs = stars(_matrix(table, width), t["side"], t["home"], t["i"][0] != t["j"][0], max_bits)
        return [(int(t["node"][a]), int(t["node"][b])) for a, b in pairs]

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        table = pa.Table.from_batches(kept)
        keys = np.stack([table.column(c).to_numpy() for c in ("block", "leaf", "i", "j")])
        ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
        links = []
        for start, end in zip([0, *ends], ends):
            if end - start > 1:
                links += close(table.slice(start, end - start))
        kept = table.slice(ends[-1] if ends else 0).combine_chunks().to_batches()
        if links:
            u, v = zip(*links)
            yield batch({"u": u, "v": v}, _LINKS)
    if kept:
        links = close(pa.Table.from_batches(kept))
        if links:
            u, v = zip(*links)
            yield batch({"u": u, "v": v}, _LINKS)


# Components


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that links (u, v) reach, for every node with a link.

    Rounds of two steps: a node's larger neighbours, then its smaller ones, are tied to the
    smallest node known around it, until nothing changes. Each round is written and read again.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "links")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        mark = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select("v", "m").distinct().toDF("u", "v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct(), "links")


def linked(nodes: DataFrame, width: int, compared: int, max_bits: int, blocks: int, radius: int, sample: int = SAMPLE, leaf: int = LEAF, own: int = OWN, tile: int = TILE) -> DataFrame:
    """u and v, nodes whose fingerprints are at most max_bits apart in the words compared, enough
    of them to span each component. nodes: node and the words of a distinct fingerprint."""
    cols = names(width)
    fitted = work.sample(nodes.select(*cols), cols, sample).collect()
    values = np.array([list(r) for r in fitted], np.int64).reshape(-1, width).view(np.uint64)
    leaf = max(leaf, len(values) * own // max(1, nodes.count()))
    trees = [t for w in range(width) for t in forest(values[:, w], blocks, leaf)]
    ddl = _ddl(_routed_schema(compared))
    keys = nodes.select("node", *cols)
    found = keys.mapInArrow(lambda it: _route(it, trees, radius, {}, width, compared), ddl).groupBy("block", "leaf").count().collect()
    parts = {k: np.ones(max(1, t.leaves), np.int64) for k, t in enumerate(trees)}
    for r in found:  # at most as many as leaves
        parts[r["block"]][r["leaf"]] = -(-r["count"] // tile)
    key = ["block", "leaf", "i", "j"]
    return (
        keys.mapInArrow(lambda it: _route(it, trees, radius, parts, width, compared), ddl)
        .repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(lambda it: _link(it, max_bits, compared), "u long, v long")
    )


def grouped(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS, **parameters) -> DataFrame:
    """doc_id, fp and component_id of every row, by fingerprints of 64 bits; exact, as the radius
    follows from max_bits and blocks."""
    prints = cut(slim(docs, "doc_id", "text").mapInArrow(lambda it: _prints(it, words, 1), _ddl(_prints_schema(1))), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links = linked(nodes.where("node is not null"), 1, 1, max_bits, blocks, max_bits // blocks, **parameters)
    named = nodes.join(components(links), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Similar texts: wide fingerprints say which texts to compare, and exact Jaccard similarity decides


def _sets_schema(width: int) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("t", "row", "k0", "k1", "n")), *((c, pa.int64()) for c in names(width)), ("parts", pa.list_(pa.int64()))])


def _parts(h: np.ndarray) -> list[int]:
    """For sets of 4 shingles their key, for sets of 5 those of the sets of 4 inside; few bits
    decide such fingerprints, so that these pairs are found by equal keys instead."""
    some = [h] if len(h) == 4 else [np.delete(h, k) for k in range(5)] if len(h) == 5 else []
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in some]


def _sets(batches: Iterator[pa.RecordBatch], words: int, width: int) -> Iterator[pa.RecordBatch]:
    """Row number, a key of 128 bits and the size of a text's set of shingles, and its fingerprint."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for b in batches:
        keys, sizes, prints, parts = [], [], [], []
        for t in texts(b.column("text")):
            h = np.unique(shingles(t, words))
            keys.append(xxhash.xxh128_digest(h.tobytes()))
            sizes.append(len(h))
            prints.append(simhash(h, width))
            parts.append(_parts(h))
        key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        fp = np.array(prints, np.uint64).reshape(-1, width).view(np.int64)
        rows = np.arange(row, row + b.num_rows)
        row += b.num_rows
        yield batch({"doc_id": b.column("doc_id"), "t": b.column("t"), "row": rows, "k0": key[:, 0], "k1": key[:, 1], "n": sizes, "parts": parts} | {c: fp[:, k] for k, c in enumerate(names(width))}, _sets_schema(width))


def similar_pairs(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of sets (of distinct values each) with that Jaccard similarity or more, enough of
    them to span each component. Every set is held against all that aren't yet in a component."""
    n = np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    bounds = np.searchsorted(row, np.arange(len(sets) + 1))
    all_columns, mark = column, np.zeros(len(times))
    left, out, queue = np.ones(len(sets), bool), [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            mine = all_columns[bounds[x] : bounds[x + 1]]
            mark[mine] = 1
            both = np.bincount(row, weights=mark[column], minlength=len(sets))
            mark[mine] = 0
            hit = np.flatnonzero(left & (both >= least * (n[x] + n - both) - 1e-6))
            if len(hit):
                left[hit] = False
                out += [(x, y) for y in hit.tolist()]
                queue += hit.tolist()
                some = left[row]  # what is left to be found
                row, column = row[some], column[some]
    return out


def _compare(batches: Iterator[pa.RecordBatch], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links inside each tile of texts; rows come sorted by tile, and a tile may span batches."""
    tile, nodes, sets = None, [], []

    def close():
        pairs = similar_pairs(sets, least) if len(sets) > 1 else []
        u, v = zip(*pairs) if pairs else ((), ())
        return batch({"u": [nodes[k] for k in u], "v": [nodes[k] for k in v]}, _LINKS)

    for b in batches:
        for key, node, text in zip(zip(*(b.column(c).to_pylist() for c in ("root", "i", "j"))), b.column("node").to_pylist(), texts(b.column("text"))):
            if key != tile:
                yield close()
                tile, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.unique(shingles(text, words)))
    yield close()


def _verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, words: int, least: float, many: int = TEXTS, shingled: int = SHINGLES) -> DataFrame:
    """Links between similar texts inside the components of links. Large components are dealt into
    parts, and every two parts meet in one task."""
    members = nodes.join(components(links), "node").select("root", "node", "rep.doc_id", "rep.t", "n")
    members = cut(members, "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / many), F.ceil(F.sum("n") / shingled), F.lit(1)).cast("int").alias("parts"))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    named = docs.join(members.select("doc_id", "t", "node"), ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"])
    tiles = named.join(dealt, "node").select("root", "i", "j", "node", "text")
    return tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda it: _compare(it, words, least), "u long, v long")


def similar_sets(docs: DataFrame, words: int, least: float, width: int, blocks: int, compared: int, max_bits: int, **parameters) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, row, k0, k1) and distinct sets of shingles (k0, k1, rep, root): texts of
    that similarity or more, and what they reach, have one root. Rows without doc_id are left out.

    rep: doc_id, row, t and copies of the first of a set's documents; t is a digest of the text.
    """
    docs = docs.select(docs["doc_id"], docs["text"]).where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    rows = cut(docs.mapInArrow(lambda it: _sets(it, words, width), _ddl(_sets_schema(width))), "sets")
    once = lambda *cs: (F.first(c).alias(c) for c in cs)
    units = rows.groupBy("doc_id", "t").agg(F.min("row").alias("row"), F.count("*").alias("copies"), *once("k0", "k1", "n", "parts", *names(width)))
    nodes = units.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "row", "t", "copies")).alias("rep"), *once("n", "parts", *names(width)))
    nodes = cut(nodes.withColumn("node", F.col("rep.row")), "nodes")
    links = linked(nodes, width, compared, max_bits, blocks, 0, leaf=1, own=1, **parameters)
    exact = cut(_verified(docs, nodes, links, words, least), "similar")
    part = nodes.select("node", "n", F.explode("parts").alias("part"))
    short = part.where("n = 4").select("part", F.col("node").alias("u")).join(part.where("n = 5").select("part", F.col("node").alias("v")), "part")
    roots = components(exact.union(short.select("u", "v")) if least <= 0.8 else exact)
    return rows.select("doc_id", "t", "row", "k0", "k1"), nodes.join(roots, "node", "left").select("k0", "k1", "rep", F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id and component_id (its smallest doc_id) of every row with a doc_id, by similarity."""
    rows, sets = similar_sets(docs, **(SIMILAR | parameters))
    sets = cut(sets, "roots")
    first = sets.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    return rows.join(sets.join(first, "root").select("k0", "k1", "component_id"), ["k0", "k1"]).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).

    Null, empty and wordless texts have fingerprint 0 and link like any other. Repeated rows
    stay, with one answer. Texts that share a doc_id have a row each; rows without doc_id belong
    to the component of their fingerprint's numbered rows, or have none. An empty table gives no
    rows; other columns are not read.
    """
    found = grouped(docs, **parameters)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs without similar texts: of each component the document with the smallest doc_id stays.

    By default texts are similar where at least 0.8 of their distinct five-word shingles are the
    same (Jaccard). A document is a doc_id with a text: different texts under one doc_id are
    different documents, and rows that repeat both stay once (which of them, where other columns
    differ, is not defined). Null, empty and wordless texts are all alike. Rows without doc_id
    stay as they are; an empty table gives no rows.
    """
    _, sets = similar_sets(docs, **(SIMILAR | parameters))
    kept = sets.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("kept_id_"), F.col("rep.t").alias("kept_t_"), F.col("rep.copies").alias("kept_copies_"))
    kept = cut(kept, "kept")
    on = (docs["doc_id"] == kept["kept_id_"]) & (F.xxhash64(docs["text"]) == kept["kept_t_"])
    single = docs.join(kept.where("kept_copies_ = 1"), on, "left_semi")
    repeated = docs.join(kept.where("kept_copies_ > 1"), on).dropDuplicates(["kept_id_", "kept_t_"]).select(*(docs[c] for c in docs.columns))
    return single.union(repeated).union(docs.where("doc_id is null"))
