"""Fill-in-the-middle transformation by secondary-sort assembly.

Each text is cut into units (white space and the word after it). Its parts go out as pieces: runs
of whole units, about 64 KB at most, keyed by document and by their place in the output. A
shuffle by document that sorts inside partitions (`repartition` and `sortWithinPartitions`, the
DataFrame form of repartitionAndSortWithinPartitions) brings each document's pieces in the order
of the output, and they stream into an incremental digest: no task holds a document. The same
stream is read back by marks and form alone into pieces keyed by their place in the text, sorted
once more inside the partition, without another shuffle, and streamed into the digest of the
restored text.

Plain documents need no assembly: their digest is taken where they are read. Rows of equal
doc_id and text give equal pieces; these meet as repeated places, so that a row repeated any
number of times is assembled once and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.work import batch, slim, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Forms, as the marks in order of the output; parts 0, 1 and 2 of the text are prefix, middle and suffix.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Bytes of a piece; a unit that is longer is cut.
CHUNK = 1 << 16
#: Shares in 100 of documents that are transformed, and of these of form spm.
RATE, SPM_RATE, SEED = 50, 80, 42
#: A document's place of what is known once its last piece has gone by.
_LAST = 3 << 32

_FACTS = [("doc_id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
_PIECES = pa.schema([("key", pa.binary()), ("place", pa.int64()), ("piece", pa.binary()), *_FACTS])
_PIECES_SQL = "key binary, place long, piece binary, doc_id long, copies long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_ROWS_SQL = "doc_id long, copies long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_NOTHING = dict.fromkeys((f.name for f in _PIECES))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: bytes) -> np.ndarray:
    """Ends (bytes) of the units of a text in UTF-8: words with the white space before them, and
    white space at the end of the text."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if len(text) else ends


def chars(text: bytes) -> int:
    return len(text) - int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 == 0x80))


def plan(doc_id: int | None, text: bytes, ends: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[str, int, int]:
    """The form of a document, and where its prefix and its middle end (in units)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", a, b
    return "spm" if h4 % 100 < spm_rate else "psm", a, b


def chunks(ends: np.ndarray, first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """Bounds (bytes) of runs of units first to last of at most `size` bytes each, if units allow;
    at least one, which may be empty."""
    at = int(ends[first - 1]) if first else 0
    stop = int(ends[last - 1]) if last else 0
    while True:
        k = int(np.searchsorted(ends, at + size, "right"))
        end = int(ends[k - 1]) if k and ends[k - 1] > at else at + size
        end = min(end, stop)
        yield at, end
        at = end
        if at >= stop:
            return


def emitted(doc_id: int | None, text: bytes, rate: int, spm_rate: int, seed: int, size: int) -> Iterator[dict]:
    """The pieces of one document, in order of its text."""
    ends = unit_ends(text)
    form, a, b = plan(doc_id, text, ends, rate, spm_rate, seed)
    facts = {"doc_id": doc_id, "copies": 1, "n": len(ends), "form": form}
    if form == "plain":
        digest = hashlib.sha256(text).hexdigest()
        yield facts | {"place": 0, "output_sha256": digest, "restored_sha256": digest}
        return
    bounds = (0, a), (a, b), (b, len(ends))
    cut = [int(ends[k - 1]) if k else 0 for k in (a, b)]
    facts |= {"prefix_chars": chars(text[: cut[0]]), "middle_chars": chars(text[cut[0] : cut[1]])}
    for part, (first, last) in enumerate(bounds):
        rank, mark = next((k, m) for k, (m, p) in enumerate(FORMS[form]) if p == part)
        for k, (start, end) in enumerate(chunks(ends, first, last, size)):
            piece = text[start:end]
            yield {"place": rank << 32 | k, "piece": piece if k else mark + piece} | (facts if not k and not rank else {"form": form})


class _Out:
    """Rows to be sent as batches of some megabytes."""

    def __init__(self):
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: dict) -> None:
        self.rows.append(_NOTHING | row)
        self.size += 300 + len(row.get("piece") or b"")

    def ready(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.size > 4 << 20):
            yield batch({f.name: [r[f.name] for r in self.rows] for f in _PIECES}, _PIECES)
            self.rows, self.size = [], 0


def _emit(batches: Iterator[pa.RecordBatch], rate: int, spm_rate: int, seed: int, size: int) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for b in batches:
        seen: dict[bytes, dict] = {}
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text"))):
            text = text or b""
            key = hashlib.blake2b(text, digest_size=16, salt=hashlib.md5(str(doc_id).encode()).digest()[:16]).digest()
            if key in seen:
                seen[key]["copies"] += 1
                continue
            for row in emitted(doc_id, text, rate, spm_rate, seed, size):
                out.add(row | {"key": key})
                if row.get("copies"):
                    seen[key] = out.rows[-1]
        yield from out.ready(True)


class Reader:
    """Reads an output back, piece by piece: the parts of the text, from marks and form alone."""

    def __init__(self, form: str):
        self.marks = list(FORMS[form])
        self.part, self.held = None, b""
        self.sent = [0, 0, 0]

    def read(self, piece: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        """Place in the text and bytes of what is certain by now."""
        data = self.held + piece
        self.held = b""
        while self.marks and (at := data.find(self.marks[0][0])) >= 0:
            yield from self._give(data[:at])
            data = data[at + 3 :]
            self.part = self.marks.pop(0)[1]
        if self.marks and not last:  # a mark may be cut
            data, self.held = data[:-2], data[-2:]
        yield from self._give(data)

    def _give(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            yield self.part << 32 | self.sent[self.part], data
            self.sent[self.part] += 1


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the output's digest, and to pieces of the restored text."""
    out, key, place = _Out(), None, -1
    facts: dict = {}
    digest = reader = None

    def end() -> None:
        if key is None:
            return
        if reader is not None:
            for where, data in reader.read(b"", True):
                out.add({"key": key, "place": where, "piece": data})
            facts["output_sha256"] = digest.hexdigest()
        out.add(facts | {"key": key, "place": _LAST})

    for b in batches:
        for row in b.to_pylist():
            if row["key"] != key:
                end()
                yield from out.ready()
                key, place = row["key"], -1
                facts = {f: row[f] for f, _ in _FACTS} | {"copies": 0}
                plain = row["form"] == "plain"
                digest, reader = (None, None) if plain else (hashlib.sha256(), Reader(row["form"]))
            facts["copies"] += row["copies"] or 0
            if row["place"] != place and reader is not None:
                digest.update(row["piece"])
                for where, data in reader.read(row["piece"]):
                    out.add({"key": key, "place": where, "piece": data})
                yield from out.ready()
            place = row["place"]
    end()
    yield from out.ready(True)


_ROWS = pa.schema(_FACTS)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of restored texts to their digests."""
    digest, rows = hashlib.sha256(), []
    for b in batches:
        for row in b.to_pylist():
            if row["place"] < _LAST:
                digest.update(row["piece"])
                continue
            if row["form"] != "plain":
                row["restored_sha256"] = digest.hexdigest()
                digest = hashlib.sha256()
            rows.append(row)
        yield batch({f: [r[f] for r in rows] for f, _ in _FACTS}, _ROWS)
        rows = []


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to whole outputs."""
    schema = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("form", pa.string()), ("output", pa.binary()), ("doc_id", pa.int64())])
    key, place, parts, facts = None, -1, [], {}

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([facts | {"key": key, "output": b"".join(parts)}], schema=schema)

    for b in batches:
        for row in b.to_pylist():
            if row["key"] != key:
                if key is not None:
                    yield made()
                key, place, parts, facts = row["key"], -1, [], {"copies": 0, "form": row["form"], "doc_id": row["doc_id"]}
            facts["copies"] += row["copies"] or 0
            if row["place"] != place:
                parts.append(row["piece"])
            place = row["place"]
    if key is not None:
        yield made()


def pieces(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """The pieces of every document with their place in the output, in no order.

    Repeated rows of a batch are counted in `copies`. Plain documents have one row without piece.
    """
    how = partial(_emit, rate=rate, spm_rate=spm_rate, seed=seed, size=size)
    return slim(docs, "doc_id", "text").mapInArrow(how, _PIECES_SQL)


def _sorted(pieces_: DataFrame) -> DataFrame:
    return pieces_.repartition("key").sortWithinPartitions("key", "place")


def _each(df: DataFrame, columns: Callable | list) -> DataFrame:
    """A row for each of the repeated rows that were counted."""
    return df.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select(*columns)


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, form and output (the text for training) of every document of form spm or psm, a row
    for each row. Documents that stay plain are the rest of the table, unchanged."""
    found = _sorted(pieces(docs, rate, spm_rate, seed).where("form <> 'plain'"))
    out = found.mapInArrow(_outputs, "key binary, copies long, form string, output binary, doc_id long")
    return _each(out.withColumn("output", F.col("output").cast("string")), ["doc_id", "form", "output"])


def round_trip(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """One row for each row of docs: n (units), form, prefix_chars, middle_chars (null if plain),
    and the digests of the output and of the text restored from it.

    A null text counts as empty, an empty one is plain with no units, and a null doc_id hashes as
    the empty string. Columns other than doc_id and text are not read.
    """
    out = _sorted(pieces(docs, rate, spm_rate, seed, size)).mapInArrow(_assemble, _PIECES_SQL)
    back = out.sortWithinPartitions("key", "place").mapInArrow(_restore, _ROWS_SQL)
    return _each(back, [f for f, _ in _FACTS if f != "copies"])
