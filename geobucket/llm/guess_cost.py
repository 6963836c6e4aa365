"""Secret scans: fixed patterns, and a guess-cost dynamic programme for values in credential contexts.

The guess cost of a value is the least sum, over all its segmentations, of
log10 costs of words (by rank, with a charge for capitals and for characters
that stand for letters), separators, dates and times, repeats, keyboard walks
and sequences, and brute-force spans (each character by the size of the value's
alphabet). A value that stands after a credential word and costs `least` or
more is a secret, whatever its characters are and whether or not a fixed
pattern covers it too. A URL, a path or an e-mail address is as hard as its
hardest part. Words are common ones of passwords and of code, and all words
that the documents hold twice or more; a text's verdicts so depend on the
table that it stands in.

A span of cost `least` or more can't be part of a cheaper segmentation, so for
a verdict the programme goes on only from the places that are reached below
`least`; their number does not grow with the value, and long values take time
in proportion to their length at most.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import os
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, local_path, scratch_path, sliced, stored

#: Base patterns, in the order in which kinds are listed.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 12),
    ("access", re.compile(r"AKIA[A-Z0-9]{14,}"), 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16),
)
KINDS = ("assign", "access", "hex", "guess")
#: Words that announce a credential.
CREDENTIAL_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential")
CONTEXT = re.compile(rf"""((?i:{"|".join(CREDENTIAL_WORDS)}))["']?[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""", re.ASCII)
#: Common words of guessed passwords, most common first.
COMMON_WORDS = (
    "password", "qwerty", "dragon", "monkey", "letmein", "football", "baseball", "master", "shadow", "welcome",
    "login", "admin", "princess", "sunshine", "michael", "superman", "batman", "trustno", "iloveyou", "hello",
    "charlie", "donald", "freedom", "whatever", "secret", "ninja", "mustang", "jordan", "hunter", "ranger",
    "summer", "winter", "spring", "autumn", "flower", "cheese", "computer", "internet", "pepper", "ginger",
    "change", "please", "test", "guest", "root", "user", "pass", "love", "money", "the",
    "example", "sample", "default", "token", "value", "null", "none", "true", "false", "your",
    "get", "set", "key", "api", "env", "process", "config", "here", "this", "self",
    "new", "app", "name", "file", "path", "data", "settings", "options", "request", "response",
    "string", "read", "load", "fetch", "input", "insert", "enter", "placeholder", "dummy", "fake",
    "auth", "access", "client", "private", "public", "session", "credentials", "system", "local", "server",
)
#: What stands between words, most common first.
SEPARATORS = ("_", "-", ".", "()", " ", "/", ":", "(", ")", "$", "{", "}", "<", ">")
#: Key rows, and sequences.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
STANDS_FOR = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
LEAST, SHORTEST = 10.0, 6
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12]\d|3[01])\3(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
_TIME = re.compile(r"(?:[01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?")
_STAMP = re.compile(rf"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt_ ]{_TIME.pattern}(?:\.\d{{1,6}})?(?:Z|[+-]\d\d:?\d\d)?", re.ASCII)
#: Values that name a place, and their parts.
_PLACE = re.compile(r"(?:[a-z][a-z0-9+.-]*://|~?/|\.{1,2}/|[a-z]:\\).*|[\w.+-]+@(?:[\w-]+\.)+(?:com|org|net|edu|gov|io|de|fr|es)", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"[^/\\?&#=:@.,;]+")


def _neighbours() -> dict[str, dict[str, int]]:
    """For each key the next keys by direction; rows are shifted by half a key."""
    out: dict[str, dict[str, int]] = {}
    place = {c: (2 * x + y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    at = {v: k for k, v in place.items()}
    for c, (x, y) in place.items():
        out[c] = {at[x + dx, y + dy]: d for d, (dx, dy) in enumerate(((2, 0), (-2, 0), (1, 1), (-1, 1), (1, -1), (-1, -1))) if (x + dx, y + dy) in at}
    for s in SEQUENCES:
        for a, b in zip(s, s[1:]):
            out[a].setdefault(b, 6)
            out[b].setdefault(a, 7)
    return out


NEXT = _neighbours()
WORD_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
SEPARATOR_COST = {x: math.log10(i + 2) for i, x in enumerate(SEPARATORS)}
_CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[A-Z]"), 26), (re.compile("[a-z]"), 26), (re.compile("[^0-9A-Za-z]"), 33))
_HEX = re.compile("[0-9a-f]+")
#: Letters of a word of documents.
SHORTEST_WORD, LONGEST_WORD = 3, 64
#: Words of a file; a task holds and maps them as two arrays of 8 bytes a word.
FILE_WORDS = 1 << 21
SEED = 42  # of Spark's xxhash64


@functools.lru_cache(4096)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray]:
    keys, classes = np.load(path, mmap_mode="r")
    return np.asarray(keys), np.asarray(classes)


@dataclass
class Words:
    """Ranks of words: hashes in sorted arrays, dealt to files by ranges of the hash, which workers map.

    The files hold a word's class of counts, `ranks` the rank of each class (at
    most 16 for each doubling of a count). Only that and the files' names are
    sent to tasks. Common words have their own rank if it is lower.
    """

    paths: dict[int, str] = field(default_factory=dict)
    files: int = 1
    ranks: dict[int, int] = field(default_factory=dict)

    def get(self, word: str) -> int | None:
        common = WORD_RANK.get(word)
        h = xxhash.xxh64_intdigest(word.encode(), SEED)
        if path := self.paths.get((h >> 32) * self.files >> 32):
            keys, classes = _mapped(path)
            at = int(keys.searchsorted(np.uint64(h)))
            if at < len(keys) and keys[at] == h:
                rank = self.ranks[int(classes[at])]
                return rank if common is None else min(common, rank)
        return common


def ranked_words(docs: DataFrame, file_words: int = FILE_WORDS) -> Words:
    """The words that all documents together hold twice or more, with their ranks.

    Values after credential words and base patterns are not counted, so a
    secret doesn't become a word by standing in a text. Counts fall into
    classes of 1/16 of a doubling; the rank of a word is the number of words of
    its class and of the classes above. No word is left out for its rank.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    low = F.lower(text)
    said = F.lit(False)
    for w in CREDENTIAL_WORDS:
        said = said | low.contains(w)
    text = F.when(said, F.regexp_replace(text, CONTEXT.pattern, " ")).otherwise(text)
    text = F.when(text.contains("AKIA"), F.regexp_replace(text, BASE[1][1].pattern, " ")).otherwise(text)
    words = docs.select(F.explode(F.split(F.lower(F.regexp_replace(text, BASE[2][1].pattern, " ")), r"[^\p{L}]+")).alias("word"))
    words = words.filter(F.length("word").between(SHORTEST_WORD, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stored(words.select(F.xxhash64("word").alias("h"), F.floor(16 * F.log2("n")).alias("class")), "words")
    found, total = Words(), 0
    for c, n in sorted((tuple(r) for r in counts.groupBy("class").count().collect()), reverse=True):
        found.ranks[c] = total = total + n
    found.files = max(1, math.ceil(total / file_words))
    folder = local_path(scratch_path(docs.sparkSession, "word-ranks"))

    def write(rows: pa.Table) -> pa.Table:
        keys = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.npy"
        np.save(f"{path}.part.npy", np.stack([keys[order], rows["class"].to_numpy().astype(np.uint64)[order]]))
        os.replace(f"{path}.part.npy", path)
        return pa.table({"file": rows["file"][:1], "path": [path]})

    file = F.shiftright(F.shiftrightunsigned("h", 32) * found.files, 32).cast("int")
    made = counts.withColumn("file", file).groupBy("file").applyInArrow(write, "file int, path string")
    found.paths = {r["file"]: r["path"] for r in made.collect()}
    dropped(docs.sparkSession, counts.scratch)
    return found


def _sent(docs: DataFrame) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(ranked_words(docs))


def _each(value: str) -> float:
    """log10 of the size of the value's alphabet."""
    return math.log10(16 if _HEX.fullmatch(value) else sum(n for x, n in _CLASSES if x.search(value)))


def _capitals(own: str) -> float:
    if own.islower() or not any(map(str.isupper, own)):
        return 0.0
    first = own[0].isupper() and not any(map(str.isupper, own[1:]))
    return math.log10(2 if first or own.isupper() else 8)


class _Repeats:
    """From a place to the end of the repetition that begins there, by the length of the repeated unit; places must not decrease."""

    def __init__(self, low: str):
        self.low, self.ends = low, {}

    def copies(self, i: int, unit: int) -> int:
        """How often the unit at i stands there, one after the other."""
        low, n, end = self.low, len(self.low), self.ends.get(unit, -1)
        if end < i:
            end = i
            while end + unit < n and low[end] == low[end + unit]:
                end += 1
            self.ends[unit] = end
        return (end - i) // unit + 1


def guess_cost(value: str, words: Mapping[str, int] | Words = WORD_RANK, limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation needs; `limit` if that is not below it."""
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    if len(low) != n:  # a few letters change their length
        low = value
    plain, each = low.translate(STANDS_FOR), _each(value)
    units = int(min(n // 2, limit / each))
    best, places, repeats = {0: 0.0}, [0], _Repeats(low)
    while places:
        i = heapq.heappop(places)
        so_far = best.pop(i)
        if i == n:
            return so_far
        for j, cost in _spans(value, low, plain, each, words, i, units, limit - so_far, repeats):
            total = so_far + cost
            if total < limit and total < best.get(j, math.inf):
                if j not in best:
                    heapq.heappush(places, j)
                best[j] = total
    return limit


def _spans(value: str, low: str, plain: str, each: float, words: Mapping[str, int] | Words, i: int, units: int, left: float, repeats: _Repeats) -> Iterator[tuple[int, float]]:
    """(end, cost) of the spans that begin at i: one character, separators, words, dates and times, repeats, walks that cost less than `left`."""
    n = len(value)
    yield i + 1, each
    for x in (low[i], low[i : i + 2]):
        if x in SEPARATOR_COST:
            yield i + len(x), SEPARATOR_COST[x]
    as_is = True
    for j in range(i + 1, min(n, i + LONGEST_WORD) + 1):
        if not plain[j - 1].isalpha():
            break
        as_is = as_is and plain[j - 1] == low[j - 1]
        if j - i >= SHORTEST_WORD and (rank := words.get(plain[i:j])):
            yield j, math.log10(rank + 1) + (0.0 if as_is else math.log10(4)) + _capitals(value[i:j])
    if "0" <= low[i] <= "9":
        if m := _DATE.match(value, i, min(n, i + 10)):
            yield m.end(), math.log10(150) if m.end() - i == 4 else math.log10(365 * 150)
        if m := _TIME.match(value, i, min(n, i + 8)):
            yield m.end(), math.log10(86400 if m[1] else 1440)
        if m := _STAMP.match(value, i, min(n, i + 32)):
            yield m.end(), math.log10(365 * 150) + math.log10(86400 if m[1] else 1440)
    for unit in range(1, units + 1):
        if i + 2 * unit <= n and (copies := repeats.copies(i, unit)) > (2 if unit == 1 else 1):
            yield i + unit * copies, unit * each + math.log10(copies)
    j, turns, last = i + 1, 0, None
    while j < n and turns * math.log10(4) < left and (d := NEXT.get(low[j - 1], {}).get(low[j])) is not None:
        turns += d != last
        last, j = d, j + 1
        if j - i >= 3:
            yield j, math.log10(47 * (j - i)) + turns * math.log10(4)


def is_secret(value: str, least: float = LEAST, words: Mapping[str, int] | Words = WORD_RANK) -> bool:
    """A credential of SHORTEST characters or more that is hard to guess; of a URL, a path or an address, some part is."""

    def hard(x: str) -> bool:
        return len(x) >= SHORTEST and guess_cost(x, words, least) >= least

    return hard(value) and (not _PLACE.fullmatch(value) or any(map(hard, _PART.findall(value))))


def secret_spans(text: str | None, least: float = LEAST, known: Mapping[str, int] | Words = WORD_RANK) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) by start, then kind. Positions are code points; time follows the length of the text."""
    text, out = text or "", []
    lower = text.lower()
    words = any(w in lower for w in CREDENTIAL_WORDS)
    for kind, (_, pattern, most) in enumerate(BASE):
        if kind == 0:
            if words:
                out += [(m.start(), 0, m.end(), m.start(2)) for m in pattern.finditer(text) if len(m[2]) >= most]
        elif kind == 2 or "AKIA" in text:
            out += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text)]
    if words:
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            if is_secret(m[m.lastindex], least, known):
                out.append((a, 3, b, a))
    return sorted(out)


def _said(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess for every row.

    Spans of the method have kind guess; one may lie inside a base span. Null
    and empty texts have no span; repeated rows give equal rows; a match may be
    as long as its text; other columns are ignored, whatever their names. An
    empty table gives no rows.
    """

    known = _sent(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows = [secret_spans(t, least, known.value) for t in b.column("text").to_pylist()]
            base = [[s for s in r if s[1] < 3] for r in rows]
            counts = [pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts[:3], pa.array([hashlib.sha256(_said(r).encode()).hexdigest() for r in base]), pa.array([_said(r) for r in rows], pa.string()), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redacted(text: str | None, least: float = LEAST, mark: str = "[SECRET]", known: Mapping[str, int] | Words = WORD_RANK) -> str | None:
    """The text with the value of every span replaced; null stays null."""
    spans = secret_spans(text, least, known)
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted((v, b) for _, _, b, v in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with secrets replaced in `text` and `n_chars` counted anew where it is there; all rows and columns stay.

    Null and empty texts stay as they are; repeated rows stay repeated; columns
    of any names are kept; an empty table gives no rows. Workers get the texts
    and return those that change: rows stay in Spark, so a batch holds its
    texts once.
    """
    known = _sent(docs)

    @F.arrow_udf("string")
    def changed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in sliced((pa.RecordBatch.from_arrays([t], ["text"]) for t in texts), "text"):
            old = b.column("text").to_pylist()
            new = [redacted(t, least, known=known.value) for t in old]
            yield pa.array([None if x is y else y for x, y in zip(old, new)], pa.string())

    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows, new = rows.withColumn("changed", changed(rows[f"c{names.index('text')}"])), F.col("changed")
    out = {"text": new}
    if "n_chars" in names:
        out["n_chars"] = F.char_length(new).cast(docs.schema["n_chars"].dataType)
    return rows.select([F.coalesce(out[n], f"c{k}") if n in out else F.col(f"c{k}") for k, n in enumerate(names)]).toDF(*names)
