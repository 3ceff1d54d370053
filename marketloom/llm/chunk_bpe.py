"""BPE encoding by content-defined chunk reuse.

A rolling hash over the last bytes cuts each text into chunks at places that depend on the
content alone, so passages that documents share give the same chunks. Each chunk is encoded once
and remembered with two places of it: the first and the last at which every encoding must cut,
whatever stands around the chunk. Text between the last such place of one chunk and the first of
the next is encoded again, and this join grows over whole chunks until both of its ends agree
exactly with token ends of its neighbours. The ids are therefore those of the whole text.

Work runs on whole texts in the tasks that read them, with no shuffle: chunks are shared within a
task, and the memory of chunks is bounded, so a hot text or a lost executor changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm.tokens import SPECIAL, SPECIAL_ID, encoder
from marketloom.llm.work import batch, slim, texts

#: Bytes that the rolling hash covers, and a cut's probability at a byte as a power of 2.
WINDOW, CUT_BITS = 16, 8
#: Bytes of chunk keys and ids that one task remembers before it starts afresh.
REMEMBERED = 64 << 20
#: Bytes hashed at once.
BLOCK = 1 << 20

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text in UTF-8, always between characters."""
    found = []
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), BLOCK):
        lead = min(start, WINDOW - 1)
        part = whole[start - lead : start + BLOCK]
        h, width = _GEAR[part], 1
        while width < WINDOW:  # sums over twice as many bytes
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h, width = wider, 2 * width
        at = np.flatnonzero(h[lead:] >> np.uint32(32 - CUT_BITS) == 0) + start + 1
        at = at[at < len(whole)]
        found.append(at[(whole[at] & 0xC0) != 0x80])
    return [*np.concatenate(found).tolist(), len(data)] if found else []


class ChunkEncoder:
    def __init__(self):
        self.bpe = encoder()
        self.chunks: dict[bytes, tuple | None] = {}
        self.joins: dict[bytes, bytes] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        mark = SPECIAL.encode()
        if mark in text:
            return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self._segment, text.split(mark)))
        return self._segment(text)

    def _segment(self, text: bytes) -> bytes:
        out, start, pending = [], 0, []
        for end in cuts(text):
            chunk = text[start:end]
            start = end
            try:
                known = self.chunks[chunk]
                self.reused += 1
            except KeyError:
                known = self._chunk(chunk)
            if known is None:  # no place to agree on: the join goes on
                pending.append(chunk)
                continue
            head, inner, tail = known
            out += (self._join(b"".join((*pending, head))), inner)
            pending = [tail]
        out.append(self._join(b"".join(pending)))
        return b"".join(out)

    def _chunk(self, chunk: bytes) -> tuple | None:
        """Bytes before the first certain place, ids from there to the last one, bytes after it."""
        data = np.frombuffer(chunk, np.uint8)
        # Pieces of the splitting pattern never go on from a visible character to a white space.
        sure = np.flatnonzero(_SPACE[data[1:]] & _GRAPH[data[:-1]]) + 1
        known = None
        if len(sure):
            ids = self.bpe.raw(chunk.decode())
            ends = np.concatenate(([0], np.cumsum(self.bpe.sizes[ids])))
            first, last = int(sure[0]), int(sure[-1])
            i, j = np.searchsorted(ends, (first, last))
            if ends[i] == first and ends[j] == last:
                known = chunk[:first], ids[i:j].tobytes(), chunk[last:]
        self.encoded += 1
        self._hold(len(chunk) + (len(known[1]) if known else 0) + 300)
        self.chunks[chunk] = known
        return known

    def _join(self, data: bytes) -> bytes:
        if not data:
            return b""
        found = self.joins.get(data)
        if found is None:
            found = self.bpe.raw(data.decode()).tobytes()
            if len(data) <= 64:
                self._hold(len(data) + len(found) + 150)
                self.joins[data] = found
        return found

    def _hold(self, size: int) -> None:
        self.held += size
        if self.held > REMEMBERED:
            self.chunks.clear()
            self.joins.clear()
            self.held = size


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chunks_encoded", pa.int64()), ("n_chunks_reused", pa.int64())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = ChunkEncoder()
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            ids = [coder.ids(t or b"") for t in texts(part.column("text"))]
            yield batch({"doc_id": part.column("doc_id"), "ids": ids}, _IDS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = ChunkEncoder()
    for b in batches:
        rows = {f.name: [] for f in _SCHEMA}
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text"))):
            encoded, reused = coder.encoded, coder.reused
            ids = coder.ids(text or b"")
            values = doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.bpe.decode(ids).encode()).hexdigest(), coder.encoded - encoded, coder.reused - reused
            for k, v in zip(rows, values):
                rows[k].append(v)
        yield batch(rows, _SCHEMA)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every text.

    A null or empty text has no ids; rows stay as they come, repeated or without doc_id; columns
    other than doc_id and text are not read.
    """
    return slim(docs, "doc_id", "text").mapInArrow(_encode, "doc_id long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of every text's ids and of what they decode to, with counts of chunks encoded and
    reused in this text. Nulls and repeated rows are as in `encode`."""
    return slim(docs, "doc_id", "text").mapInArrow(
        _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks_encoded long, n_chunks_reused long"
    )
