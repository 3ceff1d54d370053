"""Conversation repair: cheapest edits by dynamic programming with square-root checkpoints.

A conversation is right when its roles read `(s?(ua)+)?` by their initials. Edits keep, rerole,
delete or insert rows. The state is what the last role was; a row's backward vector holds the
least cost of all that follows, by state. Vectors are stored at every sqrt(n)-th row only; walking
forward, each block's vectors are computed again from the checkpoint after it, and the walk takes
the least letter (in ASCII) among the edits that stay cheapest.

Rows are range-partitioned by conversation and turn, so a conversation of any length spreads over
tasks. One that lies inside a partition and a block is repaired where it is read. The others are
cut into blocks, whose checkpoints are between blocks: each block gives its least costs from state
to state, a pass over blocks backward turns these into the vectors after each block, a pass
forward finds the state in which each begins, and blocks are then repaired side by side. Their
texts stream into a digest in order, so only one row for each block ever meets in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.work import batch, cut, slim

#: Rows and characters of a block.
BLOCK, BLOCK_CHARS = 1024, 4 << 20
#: White space, and ends of a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Costs: reroled, deleted, inserted, and kept or reroled though truncated.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. A new role's state, by state.
NEXT = (2, 2, 3, 2)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 60
#: Least cost of ending, by state: as it is, or with inserted rows.
END = (0, 2 * INSERT, INSERT, 0)

#: Codes of rows: initial (s, u, a, other) and 4 times the fault (none, to be deleted, truncated).
INITIALS = "sua"


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that use up a row, in order of letters."""
    initial, fault = code % 4, code // 4
    found = [("D", DELETE, state)]
    if fault != 1:
        more = TRUNCATED * (fault == 2)
        if initial < 3 and (state, INITIALS[initial]) in _KEPT:
            found.append(("K", more, _KEPT[state, INITIALS[initial]]))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


_EDITS = [[_edits(code, state) for state in range(4)] for code in range(12)]
_STEPS = [[[(cost, to) for _, cost, to in _EDITS[code][state]] for state in range(4)] for code in range(12)]


def before(code: int, after: tuple) -> tuple:
    """The vector before a row from the one after it."""
    v = [min([cost + after[to] for cost, to in steps]) for steps in _STEPS[code]]
    for _ in range(2):  # rows inserted before it, two at most: the third would come back to a state
        v = [min(v[k], INSERT + v[NEXT[k]]) for k in range(4)]
    return tuple(min(x, _FAR) for x in v)


def least(codes: bytes, after: tuple) -> tuple:
    """The vector before the first of some rows."""
    for code in reversed(codes):
        after = before(code, after)
    return after


def moves(codes: bytes) -> list[int]:
    """Least costs from each state before some rows to each state after them, row by row."""
    columns = [least(codes, tuple(0 if k == to else _FAR for k in range(4))) for to in range(4)]
    return [columns[to][k] for k in range(4) for to in range(4)]


def walk(codes: bytes, state: int, after: tuple) -> tuple[str, int]:
    """The cheapest edits from a state, least in ASCII, and the state after them."""
    n = len(codes)
    step = isqrt(n) + 1
    marks = {}
    vector = after
    for start in range((n - 1) // step * step, -1, -step):  # vectors at the ends of blocks only
        marks[start] = vector
        vector = least(codes[start : start + step], vector)
    letters = []
    for start in range(0, n, step):
        some = codes[start : start + step]
        vectors = [marks[start]]
        for code in reversed(some):
            vectors.append(before(code, vectors[-1]))
        for code in some:
            now, then = vectors.pop(), vectors[-1]
            while True:
                cost = now[state]
                if (found := next(((x, to) for x, c, to in _EDITS[code][state] if x == "D" and c + then[to] == cost), None)) is None:
                    if INSERT + now[NEXT[state]] == cost:
                        letters.append("I")
                        state = NEXT[state]
                        continue
                    found = next((x, to) for x, c, to in _EDITS[code][state] if c + then[to] == cost)
                letters.append(found[0])
                state = found[1]
                break
    return "".join(letters), state


def closing(state: int) -> str:
    """Edits after the last row: rows inserted so that the conversation ends with an answer."""
    return "I" * (END[state] // INSERT)


def lines(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """Rows after the edits, as role:text, and the state after them."""
    out, k = [], 0
    for x in audit:
        if x == "I":
            state = NEXT[state]
            out.append(_ROLE[state] + ":")
            continue
        if x == "K":
            state = _KEPT[state, roles[k][:1]]
            out.append(f"{roles[k]}:{texts[k]}")
        elif x == "R":
            state = NEXT[state]
            out.append(f"{_ROLE[state]}:{texts[k]}")
        k += 1
    return out, state


def faults(roles: list[str], texts: list[str], repeated: list[bool]) -> tuple[bytes, list[int]]:
    """Codes of rows, and counts of blank, duplicate and truncated ones."""
    counts, codes = [0, 0, 0], bytearray()
    for role, text, seen in zip(roles, texts, repeated):
        core = text.strip(BLANKS)
        kind = 0 if not core else 1 if seen else 2 if core[-1] not in ENDS else None
        if kind is not None:
            counts[kind] += 1
        initial = INITIALS.find(role[:1]) if role else -1
        codes.append((3 if initial < 0 else initial) + 4 * (0 if kind is None else 2 if kind == 2 else 1))
    return bytes(codes), counts


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often each row stands there after damage (0: dropped).

    Nulls of role and text become one space; conv_id and turn stay as they are, and count as one
    space in the hash that picks the damage.
    """
    d = slim(conversations, "conv_id", "turn", "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return d.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


_SUMS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())]
_RESULT = [("conv_id", pa.int64()), *_SUMS, ("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = ["first_turn", "last_turn", "n_turns"]
_READ = pa.schema([*_RESULT, ("part", pa.int64()), ("block", pa.int64()), *((c, pa.int64()) for c in _TURNS), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("repaired", pa.list_(pa.string()))])
_READ_SQL = _RESULT_SQL + ", part long, block long, first_turn long, last_turn long, n_turns long, roles array<string>, texts array<string>, digests array<binary>, repaired array<string>"


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


class _Open:
    """Rows of one conversation that a partition has read so far."""

    def __init__(self, conv_id: int | None, first: bool):
        self.conv_id, self.whole = conv_id, not first
        self.start()

    def start(self) -> None:
        self.roles, self.texts, self.chars = [], [], 0
        self.turns = [None, None, 0]

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            t = self.turns
            self.turns = [turn if t[0] is None else t[0], turn, t[2] + (turn != t[1])]

    def result(self, keep: bool) -> dict:
        """The conversation, if all of it is here."""
        seen, repeated = set(), []
        for pair in zip(self.roles, self.texts):
            repeated.append(pair in seen)
            seen.add(pair)
        codes, counts = faults(self.roles, self.texts, repeated)
        audit, state = walk(codes, 0, END)
        made, _ = lines(audit + closing(state), 0, self.roles, self.texts)
        first, last, n = self.turns
        return dict(
            zip((name for name, _ in _RESULT), (self.conv_id, last - first + 1 - n if n else 0, *counts, illegal(self.roles), least(codes, END)[0], audit + closing(state), hashlib.sha256("\n".join(made).encode()).hexdigest()))
        ) | {"repaired": made if keep else None}

    def piece(self, part: int, block: int) -> dict:
        return {"conv_id": self.conv_id, "part": part, "block": block, **dict(zip(_TURNS, self.turns)), "roles": self.roles, "texts": self.texts, "digests": [_digest(*x) for x in zip(self.roles, self.texts)]}


def _read(batches: Iterator[pa.RecordBatch], size: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows to finished conversations, and to blocks of those that may go on elsewhere."""
    from pyspark import TaskContext

    part, block, now, out = TaskContext.get().partitionId(), 0, None, []
    nothing = dict.fromkeys(f.name for f in _READ)

    def sent() -> pa.RecordBatch:
        made = batch({f.name: [(nothing | r)[f.name] for r in out] for f in _READ}, _READ)
        out.clear()
        return made

    for b in batches:
        for conv_id, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
            if now is None:
                now = _Open(conv_id, True)
            elif conv_id != now.conv_id:
                if now.whole:
                    out.append(now.result(keep))
                else:
                    out.append(now.piece(part, block))
                    block += 1
                now = _Open(conv_id, False)
            for _ in range(copies):
                if len(now.roles) >= size or now.chars > BLOCK_CHARS:
                    out.append(now.piece(part, block))
                    block, now.whole = block + 1, False
                    yield sent()
                    now.start()
                now.add(turn, role, text)
        yield sent()
    if now is not None:
        out.append(now.piece(part, block))
        yield sent()


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_CODED_SQL = "conv_id long, part long, block long, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, codes binary, moves array<long>"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes, counts and least costs of blocks."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            new = set(r.pop("firsts") or ())
            roles, texts = r.pop("roles"), r.pop("texts")
            codes, counts = faults(roles, texts, [k not in new for k in range(len(roles))])
            rows.append(r | dict(zip(_COUNTS, (*counts, illegal(roles)))) | {"first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None, "codes": codes, "moves": moves(codes)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_schema(b, "conv_id part block first_turn last_turn n_turns", [*((c, pa.int64()) for c in _COUNTS), ("first_role", pa.string()), ("last_role", pa.string()), ("codes", pa.binary()), ("moves", pa.list_(pa.int64()))]))


def _schema(b: pa.RecordBatch, kept: str, more: list) -> pa.Schema:
    return pa.schema([*(b.schema.field(c) for c in kept.split()), *more])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of each conversation: the vector after each."""
    conv, after = (), END
    for b in batches:
        found = []
        for conv_id, m in zip(b.column("conv_id").to_pylist(), b.column("moves").to_pylist()):
            if (conv_id,) != conv:
                conv, after = (conv_id,), END
            found.append(list(after))
            after = tuple(min(min(m[4 * k + to] + after[to] for to in range(4)), _FAR) for k in range(4))
        names = ["part", "block"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, "after"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the walk through each block ends, by the state in which it begins."""
    for b in batches:
        found = [[walk(codes, k, tuple(after))[1] if least(codes, tuple(after))[k] < _FAR else 0 for k in range(4)] for codes, after in zip(b.column("codes").to_pylist(), b.column("after").to_pylist())]
        names = ["conv_id", "part", "block", "codes", "after"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, "ends"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last of each conversation: the state in which each begins."""
    conv, state = (), 0
    for b in batches:
        found = []
        for conv_id, ends in zip(b.column("conv_id").to_pylist(), b.column("ends").to_pylist()):
            if (conv_id,) != conv:
                conv, state = (conv_id,), 0
            found.append(state)
            state = ends[state]
        names = ["part", "block", "codes", "after"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.int64())], names=[*names, "state"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired rows of blocks."""
    for b in batches:
        rows = []
        for r in b.select(["codes", "after", "state", "roles", "texts"]).to_pylist():
            audit, end = walk(r["codes"], r["state"], tuple(r["after"]))
            made, _ = lines(audit, r["state"], r["roles"], r["texts"])
            rows.append((audit, end, made, least(r["codes"], tuple(r["after"]))[r["state"]]))
        names = ["conv_id", "part", "block"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64())))], names=[*names, "audit", "end", "repaired", "cost"]
        )


def _gather(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Blocks in order to conversations: sums, edits and the digest of the repaired rows."""
    schema = pa.schema([*_RESULT, ("repaired", pa.list_(pa.string()))])
    conv, done = (), []

    def ended() -> None:
        tail, _ = lines(closing(row["end"]), row["end"], [], [])
        told(tail)
        first, last, n = row["turns"]
        done.append({k: row[k] for k, _ in _SUMS[1:]} | {"conv_id": conv[0], "gaps": last - first + 1 - n if n else 0, "audit": "".join(audits) + closing(row["end"]), "repaired_sha256": digest.hexdigest(), "repaired": kept if keep else None})

    def told(made: list[str]) -> None:
        for x in made:
            digest.update(f"\n{x}".encode() if row["any"] else x.encode())
            row["any"] = True
        if keep:
            kept.extend(made)

    for b in batches:
        for r in b.to_pylist():
            if (r["conv_id"],) != conv:
                if conv:
                    ended()
                conv, digest, audits, kept = (r["conv_id"],), hashlib.sha256(), [], []
                row = {"any": False, "turns": [None, None, 0], "last": None, "cost": r["cost"], **dict.fromkeys(_COUNTS, 0)}
            for c in _COUNTS:
                row[c] += r[c]
            if r["first_role"] is not None:
                row["illegal"] += row["last"] is not None and row["last"][:1] + r["first_role"][:1] not in LEGAL
                row["last"] = r["last_role"]
            if r["n_turns"]:
                first, last, n = row["turns"]
                row["turns"] = [r["first_turn"] if first is None else first, r["last_turn"], n + r["n_turns"] - (last == r["first_turn"])]
            audits.append(r["audit"])
            row["end"] = r["end"]
            told(r["repaired"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if conv:
        ended()
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def repair(damaged: DataFrame, block: int = BLOCK, keep: bool = False) -> DataFrame:
    """One row for each conversation of `damage`: counts of faults, the least cost, the edits that
    give it (`audit`: D, I, K, R; least in ASCII), and the digest of the repaired rows; with
    `keep` also `repaired`, those rows.

    Rows are in order of turn (nulls first), then of role, then of the text's hash. Null conv_ids
    are one conversation. A conversation whose rows were all dropped has zeros, no edits and the
    digest of the empty string. An empty table gives no rows.
    """
    same = [F.col(c) for c in ("conv_id", "turn", "role", "text", "hash")]
    d = slim(damaged, "conv_id", "turn", "role", "text", "copies")
    gone = F.col("copies") == 0
    d = d.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies").withColumn("hash", F.xxhash64("text"))
    rows = d.groupBy(*same).agg(F.sum("copies").alias("copies"))  # repeated rows meet here, in the tasks that read them
    rows = rows.repartitionByRange("conv_id", "turn", "role", "hash").sortWithinPartitions("conv_id", "turn", "role", "hash", "text")
    read = cut(rows.select("conv_id", "turn", "role", "text", "copies").mapInArrow(partial(_read, size=block, keep=keep), _READ_SQL), "conversations")
    columns = [c for c, _ in _RESULT] + ["repaired"]
    done = read.where("part is null").select(*columns)

    opened = read.where("part is not null")
    spot = ["part", "block"]
    each = opened.select("conv_id", *spot, F.posexplode("digests").alias("k", "digest"))
    firsts = each.groupBy("conv_id", "digest").agg(F.min(F.struct(*spot, "k")).alias("at"))
    firsts = firsts.groupBy(*(F.col(f"at.{c}").alias(c) for c in spot)).agg(F.collect_list("at.k").alias("firsts"))
    facts = opened.select("conv_id", *spot, *_TURNS, "roles", "texts").join(firsts, spot, "left")
    coded = cut(facts.mapInArrow(_code, _CODED_SQL), "codes")
    after = _by_conversation(coded.select("conv_id", *spot, "moves"), False).mapInArrow(_backward, "part long, block long, after array<long>")
    ends = coded.select("conv_id", *spot, "codes").join(after, spot).select("conv_id", *spot, "codes", "after").mapInArrow(_ends, "conv_id long, part long, block long, codes binary, after array<long>, ends array<long>")
    starts = _by_conversation(ends, True).mapInArrow(_starts, "part long, block long, codes binary, after array<long>, state long")
    pieces = opened.select("conv_id", *spot, "roles", "texts").join(starts, spot).select("conv_id", *spot, "roles", "texts", "codes", "after", "state")
    pieces = pieces.mapInArrow(_pieces, "conv_id long, part long, block long, audit string, end long, repaired array<string>, cost long")
    told = pieces.join(coded.drop("conv_id", "codes", "moves"), spot)
    whole = _by_conversation(told, True).mapInArrow(partial(_gather, keep=keep), _RESULT_SQL + ", repaired array<string>")
    out = done.unionByName(whole)
    return out if keep else out.drop("repaired")


def _by_conversation(blocks: DataFrame, forward: bool) -> DataFrame:
    """Blocks of a conversation in one task, in order; the least cost of a conversation is that of
    its first block."""
    order = [F.col(c) if forward else F.col(c).desc() for c in ("part", "block")]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", *order)
