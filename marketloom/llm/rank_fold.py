"""Byte-level BPE by folding ranked merges over the bytes of distinct words.

Spark splits texts into words (matches of the vocabulary's pattern), counts each distinct word
once, and folds merges over the bytes of the frequent ones with higher-order functions: the state
of a word is an array of its parts, a step looks the new pairs up in the rank map, a literal of the
plan, and joins the leftmost pair of least rank. The map is an array of small maps by hash, as a
lookup in one large literal map would walk it.

The frequent words with their ids (a bounded number of bounded words) go to all tasks, and texts are
encoded where they are read, without a shuffle of texts. A word beyond that bound, rare or above
`WORD` bytes (which would make the fold quadratic), is merged in the task, by a heap of the same
ranks, and remembered; every id is exact either way. Folding all distinct words with Spark costs
more than the check allows; the README has figures.

Decoding looks up the binary piece of each id in a literal array and concatenates them in the JVM.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.work import cut, ragged, slim

VOCABULARY = "byte_bpe_multi_50k"
#: Bytes of the longest word that is folded.
WORD = 64
#: Small maps of the rank map, and the factor that spreads pairs over them.
MAPS, SPREAD = 16384, 7919
#: Bits of an id and of a place in the packed state; the greatest id marks a part without a pair.
ID_BITS, PLACE_BITS = 17, 7
NO_PAIR = (1 << ID_BITS) - 1
#: Distinct words that Spark folds, the most frequent ones; they are sent to all tasks.
FREQUENT = 1 << 19
#: Rows that are encoded at once.
SLICE = 256
#: Bytes of words and ids that a task remembers beside the frequent ones.
REMEMBERED = 32 << 20


def ranks_of(name: str = VOCABULARY) -> dict[bytes, int]:
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _members(cls: str) -> str:
    """All characters that the tokenizer library's patterns count to a class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return found.decode_bytes(found.encode_ordinary(every)).decode()


def _ranges(characters: str) -> str:
    """Characters as ranges inside a Java character class."""
    codes = np.array([ord(c) for c in characters], np.int64)
    new = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    ends = np.append(new[1:], len(codes)) - 1
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(codes[new], codes[ends])) if len(codes) else ""


def java_pattern(spark: SparkSession, pattern: str = public_tokenizers.PATTERN) -> str:
    """The vocabulary's pattern for the JVM, whose Unicode tables are older: characters that only
    newer tables count to a class are added as ranges, which no ASCII character has to pass."""
    inside = {}
    for cls in (r"\s", r"\p{L}", r"\p{N}"):
        more = _ranges(spark.range(1).select(F.regexp_replace(F.lit(_members(cls)), cls + "+", "")).first()[0])
        inside[cls] = f"{cls}[\\x{{80}}-\\x{{10FFFF}}&&[{more}]]" if more else cls

    def put(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\s|\\p\{[LN]\}", lambda k: inside[k[0]], m[0])
        return f"[^{inside[chr(92) + 's']}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    return re.sub(r"\[\^?[^\]]*\]|\\s|\\S|\\p\{[LN]\}", put, pattern)


class Ranks:
    """The ranks as literals of a plan: which pairs of ids merge into which id (a merged piece's
    rank is its id), the ids of single bytes, and the pieces of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NO_PAIR or WORD >= 1 << PLACE_BITS:
            raise ValueError("ids and places don't fit into the packed state")
        maps: list[dict[int, int]] = [{} for _ in range(MAPS)]
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    maps[(a * SPREAD ^ b) & (MAPS - 1)][a << ID_BITS | b] = rank << ID_BITS | a
        # constant expressions: the optimiser turns each into one literal
        self.maps = F.from_json(F.lit(json.dumps(maps)), "array<map<string,bigint>>")
        self.bytes = F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<bigint>")
        table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        self.pieces = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in table])), "array<binary>")

    def ids(self, word: Column) -> Column:
        """Ids of a word (string, not empty, at most WORD bytes): ranked merges folded over its
        bytes. The state is an array of a number for each part: the rank of the pair that it makes
        with the next part, then its id. A step finds the least rank, leftmost, and joins that pair."""
        id_of = lambda x: x.bitwiseAND(NO_PAIR)
        last = lambda x: x.bitwiseOR(F.lit(NO_PAIR << ID_BITS))
        none = F.array().cast("array<bigint>")

        def folded(maps: Column, latin: Column) -> Column:
            def pack(a: Column, b: Column) -> Column:
                some = F.get(maps, (a * SPREAD).bitwiseXOR(b).bitwiseAND(MAPS - 1).cast("int"))
                return F.coalesce(F.try_element_at(some, F.shiftleft(a, ID_BITS).bitwiseOR(b).cast("string")), last(a))

            def join(state: Column, k: Column, new: Column) -> Column:
                before = F.when(k > 0, F.transform(F.slice(state, k, 1), lambda x: pack(id_of(x), new))).otherwise(none)
                here = F.when(k + 2 < F.size(state), F.transform(F.slice(state, k + 3, 1), lambda x: pack(new, id_of(x)))).otherwise(F.array(last(new)))
                return F.concat(F.slice(state, 1, F.greatest(k - 1, F.lit(0))), before, here, F.slice(state, k + 3, F.size(state)))

            def step(state: Column, _: Column) -> Column:
                least = F.array_min(F.transform(state, lambda x, i: F.shiftleft(F.shiftright(x, ID_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint"))))
                return _bind(least, lambda m: F.when(m < NO_PAIR << PLACE_BITS, join(state, m.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"), F.shiftright(m, PLACE_BITS))).otherwise(state))

            single = F.transform(F.sequence(F.lit(1), F.length(latin)), lambda i: F.get(self.bytes, F.ascii(F.substring(latin, i, F.lit(1)))))
            pairs = lambda ids: F.concat(F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), pack), F.array(last(F.element_at(ids, -1))))
            return F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(latin), F.lit(2))), _bind(single, pairs), step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

        # a task holds the map once, and a word becomes a character for each byte once
        return _bind(self.maps, lambda maps: _bind(F.decode(word.cast("binary"), "ISO-8859-1"), lambda latin: folded(maps, latin)))

    def decode(self, ids: Column) -> Column:
        """Bytes that ids stand for (binary)."""
        found = F.transform(ids, lambda i: F.element_at(self.pieces, i + 1).cast("string"))
        return F.array_join(found, "").cast("binary")


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def merge(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of one word of any length, little-endian unsigned 32-bit: merges from a heap of pairs."""
    whole = ranks.get(word)
    if whole is not None:
        return whole.to_bytes(4, "little")
    n = len(word)
    if n <= WORD:
        return _merge_short(word, ranks)
    start = list(range(n + 1))  # where the part that begins at i ends is start[i]; 0 marks a part merged away
    end = start[1:]
    before = [-1, *start[: n - 1]]
    heap = [(r << 32) | i for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = end[i]
        if j == 0 or j >= n or ranks.get(word[i : end[j]]) != rank:
            continue  # one of the pair has changed since
        stop = end[j]
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r << 32) | i)
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r << 32) | before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return np.array(out, "<u4").tobytes()


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """The same for a short word: pairs in a list."""
    none = len(ranks) + (1 << 32)
    get = ranks.get
    ends = list(range(1, len(word) + 1))  # of the parts
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != none:
        k = pairs.index(least)
        del ends[k], pairs[k]  # parts k and k + 1 are one now
        start = ends[k - 1] if k else 0
        if k < len(pairs):
            pairs[k] = get(word[start : ends[k + 1]], none)
        if k:
            pairs[k - 1] = get(word[ends[k - 2] if k > 1 else 0 : ends[k]], none)
    return b"".join([ranks[word[i:j]].to_bytes(4, "little") for i, j in zip([0, *ends], ends)])


class Words(dict):
    """Ids of words: the frequent ones, and others as they come, with a bound on their memory."""

    def __init__(self, frequent: dict[str, bytes], vocabulary: str):
        super().__init__(frequent)
        self.ranks, self.other, self.held = ranks_of(vocabulary), [], 0

    def __missing__(self, word: str) -> bytes:
        found = merge(word.encode(), self.ranks)
        self.held += 2 * len(word) + len(found) + 200
        if self.held > REMEMBERED:
            for w in self.other:
                del self[w]
            self.other, self.held = [], 0
        self.other.append(word)
        self[word] = found
        return found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string())])


def _encode(batches: Iterator[pa.RecordBatch], known, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Texts as words to their ids."""
    ids_of = Words(known.value, vocabulary).__getitem__
    for b in batches:
        for some in (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE)):
            column = some.column("words")
            coded = column.flatten().dictionary_encode()  # each word of these rows is looked up once
            found = list(map(ids_of, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            at = coded.indices.to_numpy()
            n, start = sizes[at], (np.cumsum(sizes) - sizes)[at]
            ends = np.cumsum(n)
            ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start - (ends - n), n) + np.arange(n.sum())]
            bounds = np.append(0, ends)[np.append(0, np.cumsum(np.asarray(column.value_lengths())))]
            digests = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(digests)], schema=_SCHEMA)


def frequent_words(words: DataFrame, size: int = FREQUENT) -> DataFrame:
    """Distinct words (column word) of at most WORD bytes that stand more than once: all that are
    at least as frequent as a bound, which leaves at most `size` of them."""
    counts = words.where(F.octet_length("word") <= WORD).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = cut(counts.withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "words")
    total, bound = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some thousands at most
        if total + r["count"] > size:
            break
        total, bound = total + r["count"], r["step"]
    return counts.where(F.col("step") >= bound if bound is not None else F.lit(False)).select("word")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids (array<int>) and their digest (little-endian unsigned 32-bit) of every text.

    A null or empty text has no ids; rows stay as they come, repeated or without doc_id; columns
    other than doc_id and text are not read. Words are counted and the frequent ones folded when
    this is called.
    """
    spark = docs.sparkSession
    pattern = F.lit(java_pattern(spark))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), pattern, F.lit(0))
    rows = slim(docs, "doc_id", "text")
    folded = frequent_words(rows.select(F.explode(words).alias("word")), frequent)
    table = folded.select("word", Ranks(ranks_of(vocabulary)).ids(F.col("word")).alias("ids")).toArrow()
    ids, ends = ragged(table.column("ids").combine_chunks())
    ids, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
    known = spark.sparkContext.broadcast({w: ids[a:z] for w, a, z in zip(table.column("word").to_pylist(), ends, ends[1:])})
    return rows.select("doc_id", words.alias("words")).mapInArrow(lambda it: _encode(it, known, vocabulary), "doc_id long, ids array<int>, ids_sha256 string")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with `decoded`, the bytes that its ids stand for."""
    return encoded.withColumn("decoded", Ranks(ranks_of(vocabulary)).decode(F.col("ids")))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, and digests of every text's ids and of what they decode to."""
    return decode(encode(docs, vocabulary, frequent), vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
