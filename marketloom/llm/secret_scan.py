"""Secrets in texts: fixed patterns, and values whose guess cost says that nobody chose them.

A value that follows a credential word is priced by the cheapest way to guess it: dynamic
programming cuts it into dictionary words, dates, repeats, keyboard walks and brute-force
characters, and adds up the logarithms of their guesses. Values above a threshold are reported
besides what the patterns find. The dictionary is the corpus's own: words are counted over all
texts (values after credential words left out), and the most frequent ones are priced by rank,
beside a short list of common passwords. Each text is then scanned whole in the task that reads it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import comb, inf, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.work import batch, cut, slim

KINDS = ("assign", "access", "hex", "guess")
#: Guesses (as a power of 10) from which a value counts as a secret, and its least length.
THRESHOLD, SHORTEST = 10.0, 8
#: Corpus words of the dictionary, their letters at least and at most, the longest part of a
#: repeat, and words counted before a task hands its partial counts on.
DICTIONARY, LETTERS, PART, HELD = 50_000, (3, 32), 64, 400_000

_letters = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
_assign = re.compile(
    "(" + "|".join(_letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + _letters("api") + "_?" + _letters("key") + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_context_names = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "pin")
#: Credential words that count anywhere in a name; the others must be words of it (author, passage,
#: monkey and opinion are none).
_anywhere = ("password", "passwd", "passphrase", "secret", "token", "credential", "apikey")
_name_words = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_fields = re.compile(r"[/._\-@?=&#:+~]+")
_access = re.compile("AKIA[A-Z0-9]{14,}")
_hex = re.compile("[0-9a-f]{16,}")
_name, _lead = "[A-Za-z0-9_-]", "(?:(?:[Bb]earer|[Bb]asic)\\x20)?"
#: A name that holds a credential word, and its value: up to the closing quote on its line, if there
#: is one. Names are tried from their first character only, so that long ones take linear time.
_context = re.compile(
    f"(?<!{_name})(?={_name}*?(?:" + "|".join(_letters(w) for w in _context_names) + "))"
    f"{_name}++[\"']?[\\x20\\t]*+(?:=>|:=|[:=])[\\x20\\t]*+{_lead}"
    f"(?:\"{_lead}((?:[^\"\\\\\r\n]|\\\\[^\r\n])++)\"|'{_lead}((?:[^'\\\\\r\n]|\\\\[^\r\n])++)'|[\"']?([^\\s\"'<>,;|]+))"
)
_names = re.compile(f"{_name}+")
_assign_words = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_context_words = tuple(w.encode() for w in _context_names)

#: Common parts of chosen passwords, the likelier the earlier.
WORDS = (
    "password pass word love admin welcome monkey dragon master login princess sunshine shadow secret football baseball letmein "
    "hello freedom whatever trust batman summer winter spring autumn super star hunter killer tiger ginger flower happy lucky "
    "test user root guest access default changeme token value example sample demo none null true false your here this that the "
    "and for with from open close company server local host data base system manager service public private key"
).split()
_rows = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_next = {a + b for row in _rows for pair in zip(row, row[1:]) for a, b in (pair, pair[::-1])}
_year, _month, _day, _sep = r"(?:19|20)\d\d", "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/._]"
_dates = [re.compile(x) for x in (_year, f"{_year}{_sep}?{_month}", f"{_year}{_sep}?{_month}{_sep}?{_day}", rf"{_day}{_sep}{_month}{_sep}\d\d", f"{_day}{_sep}{_month}{_sep}{_year}")]


class Dictionary:
    """Guesses (as a power of 10) of lower-case words: their place among common passwords or
    among the corpus's words, whichever is less."""

    def __init__(self, words: list[str] = ()):
        self.cost = {w: log10(k + 2) for k, w in enumerate(words)}
        for k, w in enumerate(WORDS):
            self.cost[w] = min(self.cost.get(w, inf), log10(k + 2))
        self.longest = max(map(len, self.cost))


PASSWORDS = Dictionary()


def single(c: str) -> float:
    """Guesses for one character, as a power of 10."""
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def case_cost(word: str) -> float:
    """Guesses for the case of a word: one capital first or capitals only, or any mixture."""
    up = sum(map(str.isupper, word))
    if not up:
        return 0.0
    low = sum(map(str.islower, word))
    if not low or (up == 1 and word[0].isupper()):
        return log10(2)
    return log10(sum(comb(up + low, k) for k in range(1, min(up, low) + 1)))


def walk_cost(length: int, turns: int) -> float:
    return log10(47 * length) + turns * log10(4)


def date_ends(value: str, i: int) -> list[tuple[int, float]]:
    """Ends of the dates that start at i, with their guesses."""
    found = (m for m in (d.match(value, i) for d in _dates) if m)
    return [(m.end(), log10(120 * (365.25 if m.end() - i > 4 else 1))) for m in found]


def guess_cost(value: str, dictionary: Dictionary = PASSWORDS, limit: float = inf) -> float:
    """Least guesses (as a power of 10) over all ways to cut value into known parts; a cost of at
    least `limit` may come out as any such number.

    A repeat is a part of at most PART characters, itself no repeat, two times or more. Of the
    places where a repeat could begin only those are kept that another hasn't beaten for good, so
    that long repeats take linear time.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    best = [0.0] + [inf] * n
    cost, longest = dictionary.cost, dictionary.longest
    walk = 0  # where the present keyboard walk began
    turned: list[int] = []  # places in it where it turns back
    agree = [0] * (PART + 1)  # for each part length: characters up to here that repeat those before
    starts: dict[int, list[list[int]]] = {}  # and the places where its repeats may begin, by remainder
    parts: dict[str, tuple[bool, float]] = {}
    reach = 0  # the last place that something begun at a cost below the limit can reach
    for j in range(1, n + 1):
        c = value[j - 1]
        now = min(best[j], best[j - 1] + single(c))
        for i in range(max(0, j - longest), j - 1):
            if best[i] < now:
                known = cost.get(low[i:j])
                if known is not None:
                    now = min(now, best[i] + known + case_cost(value[i:j]))
        # keyboard walks of three characters or more, from every start
        if j > 1 and low[j - 2 : j] not in _next:
            walk, turned = j - 1, []
        elif j > 2 and j - walk > 2 and low[j - 3] == low[j - 1]:
            turned.append(j - 2)
        if j - walk > 2:
            turns = 0
            for i in range(j - 3, walk - 1, -1):
                while turns < len(turned) and turned[-1 - turns] > i:
                    turns += 1
                if turns * log10(4) >= now:
                    break
                now = min(now, best[i] + walk_cost(j - i, turns))
        # repeats
        live = False
        for p in range(1, min(PART, j - 1) + 1):
            if c != value[j - 1 - p]:
                if agree[p]:
                    agree[p] = 0
                    starts.pop(p, None)
                continue
            agree[p] += 1
            if agree[p] < p:
                continue
            part = value[j - p : j]
            known = parts.get(part)
            if known is None:
                whole = (part + part).find(part, 1) == p  # no repeat itself
                known = parts[part] = whole, guess_cost(part, dictionary) if whole and p < n else inf
                if len(parts) > 4096:
                    parts.clear()
            if not known[0]:
                continue
            places = starts.setdefault(p, [[] for _ in range(p)])[j % p]
            i = j - 2 * p
            while places and best[places[-1]] >= best[i]:
                places.pop()
            places.append(i)
            kept: list[int] = []
            for i in places:
                f = best[i] + log10((j - i) // p)
                if not kept or f < least:  # an earlier place that is no worse now stays so
                    least = f
                    kept.append(i)
            places[:] = kept
            now = min(now, known[1] + least)
            live = live or best[places[0]] < limit
        best[j] = now
        if now < limit:
            reach = max(reach, j + longest)
        if c.isdigit():
            for end, guesses in date_ends(value, j - 1):
                best[end] = min(best[end], best[j - 1] + guesses)
                if best[end] < limit:
                    reach = max(reach, end)
        if limit < inf and not live and j > reach + 2 * PART and min(best[walk:j], default=limit) >= limit:
            return limit  # nothing cheap can reach the end
    return best[n]


def is_prose(value: str, dictionary: Dictionary) -> bool:
    """Whether value is several words of the dictionary or of one or two letters."""
    words = value.split()
    if len(words) < 2:
        return False
    bare = (w.strip(".,;:!?()[]'\"").lower() for w in words)
    return all(w in dictionary.cost or len(w) < LETTERS[0] and not any(map(str.isdigit, w)) for w in bare)


def is_credential(name: str) -> bool:
    """Whether a name stands for a credential: by a word of it (split at digits, hyphens,
    underscores and capitals), or by a word that means nothing else anywhere in it."""
    low = name.lower()
    return any(w in low for w in _anywhere) or any(w.lower() in _context_names for w in _name_words.findall(name))


def _is_speakable(field: str) -> bool:
    """A word in one case or with a capital first, of a shape that people can say, or a number of
    up to four digits."""
    if field.isdigit():
        return len(field) <= 4
    if not field.isalpha() or not (field.islower() or field.isupper() or field.istitle()):
        return False
    vowels = sum(c in "aeiouy" or not c.isascii() for c in field.lower())
    return len(field) <= 3 or field == "html" or (vowels * 5 >= len(field) and not re.search("[bcdfghjklmnpqrstvwxz]{5}", field.lower()))


def is_structured(value: str) -> bool:
    """Whether value is a URL, a path, a mail address, or an identifier of words with one separator
    throughout. Their parts are words that can be spoken, so a passphrase of this form is one too;
    a URL that names a user's password isn't."""
    scheme, found, rest = value.partition("://")
    rest = rest if found else value
    if found and (not scheme.isalnum() or "@" in rest.split("/")[0]):
        return False
    fields = [f for f in _fields.split(rest) if f]
    if len(fields) < 2 or not all(map(_is_speakable, fields)):
        return False
    return bool(found) or value[:1] in "/~." or rest.count("@") == 1 or len(set("".join(_fields.findall(rest)))) == 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words made of letters, outside values after credential words."""
    letters = re.compile(f"[^\\W\\d_]{{{LETTERS[0]},}}")

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            t = t or ""
            low = t.lower()
            if any(w in low for w in _context_names):
                low = _context.sub(lambda m: " " if is_credential(_names.match(m[0])[0]) else m[0], t).lower()
            seen.update(w for w in letters.findall(low) if len(w) <= LETTERS[1])
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def dictionary_of(docs: DataFrame, words: int = DICTIONARY) -> Dictionary:
    """The most frequent words of all texts: all that are at least as frequent as a bound, which
    leaves at most `words` of them; only these reach the driver."""
    counts = docs.select(docs["text"]).mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = cut(counts.withColumn("step", step), "words")
    total, bound = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some hundreds
        if total + r["count"] > words:
            break
        total, bound = total + r["count"], r["step"]
    found = [] if bound is None else counts.where(F.col("step") >= bound).collect()
    return Dictionary([r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))])


def spans(text: str, dictionary: Dictionary = PASSWORDS) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) of every secret; the added kind is never wholly inside
    another. Several words of the dictionary are prose, and URLs, paths, addresses and identifiers
    of words are no secrets either."""
    low = text.encode().lower()
    found = []
    if any(w in low for w in _assign_words):
        found += [("assign", *m.span()) for m in _assign.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        found += [("access", *m.span()) for m in _access.finditer(text)]
    found += [("hex", *m.span()) for m in _hex.finditer(text)]
    if any(w in low for w in _context_words):
        taken = [(a, b) for _, a, b in found]
        for m in _context.finditer(text):
            a, b = m.span(m.lastindex)
            if b - a < SHORTEST or any(x <= a and b <= y for x, y in taken) or not is_credential(_names.match(m[0])[0]):
                continue
            value = text[a:b]
            if not is_prose(value, dictionary) and not is_structured(value) and guess_cost(value, dictionary, THRESHOLD) >= THRESHOLD:
                found.append(("guess", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, dictionary: Dictionary = PASSWORDS, mark: str = "[SECRET]") -> str:
    """text with each stretch of overlapping secrets replaced by a mark."""
    out, at = [], 0
    end = -1
    for _, a, b in sorted(spans(text, dictionary), key=lambda x: x[1]):
        if a >= end:
            out += (text[at:a], mark)
        end = at = max(end, b)
    return "".join((*out, text[at:])) if out else text


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = {f.name: [] for f in _SCHEMA}
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            found = spans(text or "", shared.value)
            count = [sum(1 for x in found if x[0] == k) for k in KINDS]
            base = _joined(x for x in found if x[0] != "guess")
            for name, v in zip(rows, (doc_id, *count[:3], hashlib.sha256(base.encode()).hexdigest(), _joined(found), count[3])):
                rows[name].append(v)
        yield batch(rows, _SCHEMA)


def _shared(docs: DataFrame, dictionary: Dictionary | None):
    """A dictionary (by default the texts' own), which its word count bounds, for all tasks."""
    return docs.sparkSession.sparkContext.broadcast(dictionary or dictionary_of(docs))


def scan(docs: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Counts and spans of secrets for every row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_guess.

    A null or empty text has none; repeated rows and rows without doc_id are scanned like any
    other; other columns are not read; an empty table gives no rows. Words are counted when this
    is called.
    """
    shared = _shared(docs, dictionary)
    return slim(docs, "doc_id", "text").mapInArrow(
        lambda it: _scan(it, shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )


def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = [None if t is None else redact(t, shared.value) for t in b.column("text").to_pylist()]
        columns = {f.name: b.column(f.name) for f in b.schema} | {"text": new}
        if "n_chars" in columns:
            columns["n_chars"] = [None if t is None and n is None else len(t or "") for t, n in zip(new, b.column("n_chars").to_pylist())]
        yield batch(columns, b.schema)


def clean(docs: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars (if present) counted anew."""
    shared = _shared(docs, dictionary)
    return docs.mapInArrow(lambda it: _clean(it, shared), docs.schema)
