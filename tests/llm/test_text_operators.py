"""Fill-in-the-middle, folded byte-level BPE and conversation repair against plain code."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketloom.llm import conversation_repair, fim_assembly, queries, rank_fold
from tests.oracle import DATA

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    "one two three four five six", "", None, " ", "\n\n x", "a", "tail \t\r\n", "has <P> inside", "<S", "P>P>", "<<P", "élève  naïve 日本語  x\x1cy", "word " * 40000, "x" * 300_000, "\t" * 200_000,
    "'ll we're I'm 'Tis 12345 ½ ² Ⅷ १२", "\U0001e030ࢗ\U00016d40\U00031350 new letters \U0001ccf0", "👍🏽‍♀️ ok\u0000\x85x", " 　  a", "<|endoftext|>" * 3, "aaaaaaaaab" * 9, "one two three four five six",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, each repeated row, null ids and columns whose names the operators use."""
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "z", 3, 4, "q")] * 5 + [(None, "no id at all here", None, None, None, None), (0, "another text", None, None, None, None)]
    rows += [(i, f"{'ab ' * (i % 7)}text {i}", "x", 1, 2, "y") for i in range(100, 300)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, bucket long, place long, key string").repartition(5).cache()


def fim(doc_id, text, rate=50):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.mark.parametrize("size", [1 << 16, 7])
def test_fim_round_trip(docs, size):
    rows = docs if size > 7 else docs.where("coalesce(length(text), 0) < 1000")
    got = fim_assembly.round_trip(rows, rate=90, size=size).collect()
    want = [(r.doc_id, *(w := fim(r.doc_id, r.text or "", 90))[:4], sha(w[4]), sha(r.text or "")) for r in rows.collect()]
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got))) == sorted(map(str, want))


def test_fim_outputs_and_empty_table(spark, docs):
    got = fim_assembly.transform(docs).collect()
    want = [(r.doc_id, w[1], w[4]) for r in docs.collect() if (w := fim(r.doc_id, r.text or ""))[1] != "plain"]
    assert sorted(map(str, ((r.doc_id, r.form, r.output) for r in got))) == sorted(map(str, want))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim_assembly.round_trip(none).count() == 0 and rank_fold.round_trip(none).count() == 0


def test_fim_reader_with_cut_marks():
    out = b"<P>a <<S>s<S<M>m>"
    for size in (1, 2, 3, 5, 50):
        reader, found = fim_assembly.Reader("psm"), []
        for k in range(0, len(out), size):
            found += reader.read(out[k : k + size])
        found += reader.read(b"", True)
        assert b"".join(x for _, x in sorted(found)) == b"a <m>s<S"


def plain_encoder():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_fold.ranks_of(), special_tokens={})


def test_fold_equals_the_library(docs):
    enc = plain_encoder()
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text or "")))
    for frequent in (rank_fold.FREQUENT, 5, 0):
        got = rank_fold.round_trip(docs, frequent=frequent).collect()
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(map(str, want))


def test_every_folded_word_equals_the_heap(spark):
    """Words of one to 64 bytes, of every script in the documents and of random bytes' characters."""
    draw, ranks = random.Random(9), rank_fold.ranks_of()
    words = [" naïveté", "a", "\u00e9", "  ", "日本語日本語", "x" * 64, "zqzqzqzq", "0123456789012345", "\u0000\u0001", "🤖🤖🤖"]
    words += ["".join(draw.choice("abcdefgh étß日\U0001f600") for _ in range(draw.randint(1, 12))) for _ in range(800)]
    words = [w for w in words if len(w.encode()) <= 64]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = df.select("word", rank_fold.Ranks(ranks).ids(F.col("word")).alias("ids")).collect()
    enc = plain_encoder()
    for r in got:
        assert r.ids == enc._encode_single_piece(r.word) == np.frombuffer(rank_fold.merge(r.word.encode(), ranks), "<u4").tolist()


def test_splitting_pattern_knows_every_character(spark):
    """The JVM splits around each code point as the library does."""
    enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in (*range(0xD800), *range(0xE000, 0x110000)))
    words = spark.createDataFrame([(text[k : k + 70_000],) for k in range(0, len(text), 70_000)], "text string").select("text", F.regexp_extract_all("text", F.lit(rank_fold.java_pattern(spark)), F.lit(0)).alias("w"))
    import regex

    classes = {c: rank_fold._members(rf"\p{{{c}}}") if c != "s" else rank_fold._members(r"\s") for c in "LNs"}
    own = {k: set(v) for k, v in classes.items()}
    kind = lambda c: "s" if c in own["s"] else "L" if c in own["L"] else "N" if c in own["N"] else "o"
    assert enc.decode(enc.encode_ordinary(text[:100])) == text[:100]
    for r in words.collect():  # words never mix classes, bar a blank or an apostrophe before them
        assert "".join(r.w) == r.text
        for w in r.w:
            assert len({kind(c) for c in w[1:]}) <= 1 and (len(w) < 2 or w[0] in " '" or kind(w[0]) == kind(w[1])), w
        assert not any(kind(a[-1]) == kind(b[0]) != "s" and a[-1] != "'" and not re.fullmatch("'(s|t|re|ve|m|ll|d)", a) for a, b in zip(r.w, r.w[1:]) if kind(b[0]) != "s")
    assert regex


@pytest.mark.parametrize("word", ["aaaaaaaaab" * 30, "abcabcxyz" * 500, "éàü" * 100, " " * 5000, "0123456789" * 50])
def test_heap_merges(word):
    enc, ranks = plain_encoder(), rank_fold.ranks_of()
    assert np.frombuffer(rank_fold.merge(word.encode(), ranks), "<u4").tolist() == enc._encode_single_piece(word)


def test_op11_and_op12_on_the_table(spark):
    enc = plain_encoder()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op11_fim_assembly(spark, DATA).collect():
        w = fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*w[:4], sha(w[4]), sha(docs[r.doc_id]))
    for r in queries.op12_rank_fold_bpe(spark, DATA).collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id]))


def damaged(rows):
    """Rows of (conv_id, turn, role, text) after damage, in order, by conversation."""
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        found += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def best(rows):
    """All that op13 returns for one conversation, by trying every edit."""
    blank = duplicate = truncated = 0
    seen, kinds = set(), []
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not core else "dup" if (role, text) in seen else "cut" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "dup"), truncated + (kind == "cut")

    right = re.compile("(s?(ua)+)?")

    @functools.cache
    def cheapest(k, state):
        found = []
        if k == len(rows) and state in "|a":
            found.append((0, "", ()))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}

        def then(letter, cost, role, text, at):
            c, audit, made = cheapest(at, role[0])
            found.append((c + cost, letter + audit, ((role, text), *made)))

        if k < len(rows):
            _, role, text = rows[k]
            c, audit, made = cheapest(k + 1, state)
            found.append((c + 2, "D" + audit, made))
            if kinds[k] in ("", "cut"):
                more = 5 if kinds[k] else 0
                if role[:1] and role[0] in follow[state]:
                    then("K", more, role, text, k + 1)
                for new in ("user", "assistant"):
                    if new[0] in follow[state]:
                        then("R", more + 1, new, text, k + 1)
        return min(found + inserted(k, state, found, follow))

    def inserted(k, state, found, follow, depth=0):
        """Rows put in front of row k, two at most."""
        out = []
        for n, roles in ((1, ["user"]), (1, ["assistant"]), (2, ["user", "assistant"]), (2, ["assistant", "user"])):
            s, ok = state, True
            for r in roles:
                ok &= r[0] in follow[s]
                s = r[0]
            if ok:
                direct = [x for x in plain(k, s) if x]
                out += [(c + 5 * n, "I" * n + audit, (*((r, "") for r in roles), *made)) for c, audit, made in direct]
        return out

    def plain(k, state):
        """Without rows put in front of row k."""
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}
        found = [(0, "", ())] if k == len(rows) and state in "a" else []
        if k < len(rows):
            _, role, text = rows[k]
            c, audit, made = cheapest(k + 1, state)
            found.append((c + 2, "D" + audit, made))
            if kinds[k] in ("", "cut"):
                more = 5 if kinds[k] else 0
                tries = [("K", more, role)] if role[:1] and role[0] in follow[state] else []
                tries += [("R", more + 1, new) for new in ("user", "assistant") if new[0] in follow[state]]
                for letter, cost, new in tries:
                    c, audit, made = cheapest(k + 1, new[0])
                    found.append((c + cost, letter + audit, ((new, text), *made)))
        return found

    cost, audit, made = cheapest(0, "")
    assert right.fullmatch("".join(r[0] for r, _ in made))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made))


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("block", "parts"), [(1024, "4"), (3, "4"), (1, "7")])
def test_repair_equals_every_edit_tried(spark, block, parts):
    draw = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.choice((0, 1, 2, 5, 9, 14))):
            text = draw.choice(["Fine.", "Fine.", "no end", "", " \x0b", "What? ", "x ", None, "Really!\n", f"t{turn}."])
            rows.append((conv, draw.choice([turn, turn, turn * 3, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]), text))
    seen: dict = {}
    rows = [seen.setdefault((r[0], r[1]), r) for r in rows]  # rows of one turn are equal, so that their order is known
    odd = [(*r, 1, "x") for r in rows]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, copies int, hash string").repartition(3)
        got = {r.conv_id: tuple(r[c] for c in NAMES) for r in conversation_repair.repair(conversation_repair.damage(df), block=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {c: best(tuple(x)) for c, x in damaged(rows).items()}


def test_repair_of_one_long_conversation(spark):
    """One conversation in many tasks and blocks gives what one task gives."""
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 11 else "tool", f"Text {i % 400}{'.' if i % 5 else ''}") for i in range(3000)]
    d = conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = conversation_repair.repair(d, block=64, keep=True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = damaged(rows)[7]
    seen, repeated = set(), []
    for _, r, t in want:
        repeated.append((r, t) in seen)
        seen.add((r, t))
    codes, counts = conversation_repair.faults([r for _, r, _ in want], [t for _, _, t in want], repeated)
    audit, state = conversation_repair.walk(codes, 0, conversation_repair.END)
    assert [(r.audit, r.blank, r.duplicate, r.truncated) for r in many] == [(audit + conversation_repair.closing(state), *counts)]
    assert sha("\n".join(many[0].repaired)) == many[0].repaired_sha256
    assert conversation_repair.repair(d.limit(0)).count() == 0


def test_op13_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in queries.op13_conversation_repair(spark, DATA).collect()}
    assert got == {c: best(tuple(x)) for c, x in damaged(rows).items()}
