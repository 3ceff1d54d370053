"""Packing of documents into sequences by swap-based local search.

Documents are encoded where they are read and cut into pieces, whose ids are written once. Only
row numbers and lengths of pieces are then dealt by a hash into groups of bounded size. A group
starts from best fit in decreasing order. Local search goes on from there until the volume bound
is reached or no step is left: the emptiest sequence gives its pieces away, by moves or in
exchange for one or two smaller pieces, always so that the sum of squared fills grows, until it
is empty or stuck. Places are joined back to the pieces by row number.

Where there are many small pieces the start is at the bound already; pieces between a quarter and
a half of a sequence are where exchanges empty most.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.tokens import encoder
from marketloom.llm.work import batch, cut, slim

CAPACITY, END_ID = 1024, 2
#: Pieces in a group, about, and steps of the search for each piece of a group, at most.
GROUP, STEPS = 16_384, 8
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
_PIECES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bpe, end = encoder(), np.array([END_ID], "<u4").tobytes()
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            rows = {f.name: [] for f in _PIECES}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = bpe.ids(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                whole_ids = np.frombuffer(ids, "<i4")
                for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    for name, v in zip(rows, (row, doc_id, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), whole_ids[i:j])):
                        rows[name].append(v)
                    row += 1
            yield batch(rows, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest sequence that still takes it."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by what is left
    free = 0  # bit r: some sequence has r left
    for i in order:
        n = sizes[i]
        above = free >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
        if r > n:
            room[r - n].append(k)
            free |= 1 << (r - n)
    return bins


class Search:
    """Local search over the underfull sequences of one group.

    Every underfull sequence is indexed by its room and by each amount that it could give back:
    nothing, one piece, or two. A piece of size a goes best where room and amount given back add
    up to a: the other sequence is then full. All sequences take part.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.sizes, self.capacity = bins, lengths.tolist(), capacity
        self.fill = [sum(self.sizes[i] for i in b) for b in bins]
        self.ways: dict[tuple[int, int], set[int]] = {}
        #: whether some sequence has a room (column) and can give back what makes up the row's sum
        self.have = np.zeros((2 * capacity + 1, capacity + 1), bool)
        self.beyond = np.arange(capacity + 1)[None, :] > np.arange(capacity + 1)[:, None]
        self.count = sum(1 for b in bins if b)
        self.least = -(-sum(self.sizes) // capacity)

    def _amounts(self, k: int) -> set[int]:
        sizes = sorted(self.sizes[i] for i in self.bins[k])
        out, seen = {0}, set()
        for s in sizes:
            if s in seen and 2 * s in out:
                continue
            out.update(s + t for t in seen)
            out.add(s)
            seen.add(s)
        return out

    def _add(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            for back in self._amounts(k):
                self.ways.setdefault((room, back), set()).add(k)
                self.have[room + back, room] = True

    def _drop(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            for back in self._amounts(k):
                some = self.ways[room, back]
                some.discard(k)
                if not some:
                    del self.ways[room, back]
                    self.have[room + back, room] = False

    def _best(self, size: int, room: int) -> tuple[int, int] | None:
        """Room and amount given back that leave another sequence fullest for a piece of a
        sequence with `room`; the sum of squares must grow."""
        low, width = 0, 8
        while low < room:
            high = min(room, low + width)
            found = self.have[size + low : size + high] & self.beyond[low:high]
            rows = np.flatnonzero(found.any(1))
            if len(rows):
                other = int(np.flatnonzero(found[rows[0]])[-1])
                return other, size + low + int(rows[0]) - other
            low, width = high, width * 4
        return None

    def _back(self, k: int, amount: int) -> list[int]:
        """One piece of a sequence, or two, of that size together."""
        of: dict[int, int] = {}
        if amount:
            for i in self.bins[k]:
                if self.sizes[i] == amount:
                    return [i]
            for i in self.bins[k]:
                if amount - self.sizes[i] in of:
                    return [of[amount - self.sizes[i]], i]
                of[self.sizes[i]] = i
        return []

    def _give(self, k: int) -> bool:
        """One step that takes a piece out of sequence k, the largest that can go."""
        room = self.capacity - self.fill[k]
        for size, i in sorted({self.sizes[i]: i for i in self.bins[k]}.items(), reverse=True):
            found = self._best(size, room)
            if found is None:
                continue
            other = next(iter(self.ways[found]))
            self._drop(other)
            back = self._back(other, found[1])
            self.bins[k].remove(i)
            for x in back:
                self.bins[other].remove(x)
            self.bins[k] += back
            self.bins[other].append(i)
            self.fill[other] += size - found[1]
            self.fill[k] += found[1] - size
            self._add(other)
            return True
        return False

    def run(self, steps: int) -> list[list[int]]:
        for k in range(len(self.bins)):
            self._add(k)
        changed = True
        while changed and steps > 0:
            changed = False
            queue = [(self.fill[k], k) for k in range(len(self.bins)) if 0 < self.fill[k] < self.capacity]
            heapq.heapify(queue)
            while queue and steps > 0 and self.count > self.least:
                fill, k = heapq.heappop(queue)
                if fill != self.fill[k]:  # changed meanwhile: it takes its new place
                    if 0 < self.fill[k] < self.capacity:
                        heapq.heappush(queue, (self.fill[k], k))
                    continue
                self._drop(k)
                while self.bins[k] and steps > 0 and self._give(k):
                    steps -= 1
                    changed = True
                if self.bins[k]:
                    self._add(k)
                else:
                    self.count -= 1
            changed = changed and self.count > self.least
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, steps: int | None = None) -> list[list[int]]:
    """bins after the search: as many or fewer, each of at most the capacity."""
    return Search([list(b) for b in bins], lengths, capacity).run(STEPS * len(lengths) if steps is None else steps)


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for k, b in enumerate(bins):
        sequence[b] = k
        offset[b] = np.cumsum(lengths[b]) - lengths[b]
    group = pdf["pack_group"].to_numpy(np.int64)
    return pd.DataFrame({"row": pdf["row"], "sequence_id": (group << 32) + sequence, "offset": offset})


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset.

    A document is its ids and one end id; a null or empty text is the end id alone. Documents
    longer than `capacity` are cut from their end, so that only the first piece is shorter.
    Repeated rows are packed as often as they come; a null doc_id stays null; an empty table
    gives no rows; other columns are not read. Ids are read again only if they are asked for.
    """
    pieces = cut(slim(docs, "doc_id", "text").mapInArrow(lambda it: _pieces(it, capacity), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    places = (
        pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("pack_group"))
        .groupBy("pack_group")
        .applyInPandas(lambda pdf: _pack(pdf, capacity), "row long, sequence_id long, offset long")
    )
    return pieces.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
