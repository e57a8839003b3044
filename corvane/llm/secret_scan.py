"""Secret scan: base patterns, and novelty measured with a primed compressor.

A candidate is a string that stands in a sensitive context: after a word such as
"key", or looking like a key by itself.  Its novelty is the number of bytes that
it adds to the compressed form of its surroundings, with zstandard primed by a
dictionary of identifiers: names of code, and the words that the corpus itself has
most often, counted over all of it.  Words, names and repeated strings cost a few
bytes; a random secret costs nearly as many bytes as its own entropy.

Limits: a candidate has 12 characters or more and a digit (letters alone can't be told
from rare words by their bytes), and stands directly behind its sensitive word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked import afresh
from .common import small_batches, table

#: The base patterns; least lengths of what they find.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")

#: Candidates beyond the base: an identifier with a sensitive word, a few characters, a string; or a string that mixes classes.
#: The string is only looked at, so that a sensitive word inside it has a string of its own.  As one pattern this
#: would walk an identifier again for each word in it; candidates() finds the same and walks it once.
_SENSITIVE = "(?:key|pwd|pass|secret|token|auth|bearer|credential|private|signature|session|cookie|salt|cert)"
_AFTER = r"[\"']?[\x20\t]{0,4}(?:[:=]>?|[\x20\t]is|[\x20\t]|\()[\x20\t]{0,4}[\"'`]?(?=[A-Za-z0-9+/_=~.-]{12})"
_HINTS = _SENSITIVE[3:-1].split("|")  # most texts have none, and a plain search tells
_CONTEXT = re.compile(f"{_SENSITIVE}[A-Za-z0-9_]*{_AFTER}", re.ASCII | re.IGNORECASE)
_WORDS, _REST, _BETWEEN = re.compile(_SENSITIVE, re.ASCII | re.IGNORECASE), re.compile("[A-Za-z0-9_]*"), re.compile(_AFTER, re.ASCII | re.IGNORECASE)
_STRING, _DIGIT = re.compile(r"[A-Za-z0-9+/_=~.-]+"), re.compile("[0-9]")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|npm_|hf_)[A-Za-z0-9_.-]{16,}")
_PREFIXES = ("gh", "github_pat_", "glpat-", "sk", "rk_", "xox", "AIza", "eyJ", "npm_", "hf_")

#: Words that are no secrets where they stand beside sensitive names.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_secret client_id user username "
    "authorization bearer basic session cookie signature certificate credential default example placeholder changeme "
    "your_password_here your_api_key none null true false undefined function return import class string number object "
    "get set value config settings environment variable process.env os.environ http https localhost localhost:8080 "
    "application/json content-type text/html utf-8 base64 sha256 md5 hmac aes rsa jwt oauth2 expires_in refresh_token "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 xxxxxxxxxxxxxxxxxxxx "
    "------------------------ ======================== ........................ the of and to in is that for it with as "
)
#: A word of letters that is no part of a longer string; it can't be a candidate, which holds a digit.
_PLAIN = r"(?<![A-Za-z0-9_+/=~-])[A-Za-z_]{4,32}(?![A-Za-z0-9_+/=~])"


def identifiers(docs: DataFrame, most: int = 4096) -> str:
    """The dictionary: IDENTIFIERS behind the ``most`` words that all texts of ``docs`` have most often, ties by code point, the most frequent last."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_PLAIN), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join([*(r["word"] for r in reversed(top)), IDENTIFIERS])


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, known: str = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.press = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False)

    def bytes(self, before: str, candidate: str, after: str) -> int:
        around = f"{before}\n{after}\n"
        return len(self.press.compress(f"{around}{candidate}".encode())) - len(self.press.compress(around.encode()))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, by start, then kind as listed in KINDS."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of strings in sensitive contexts, whatever their content; those of one string end together."""
    walked, end, out, low = 0, 0, set(), text.lower()
    for m in _WORDS.finditer(text) if any(h in low for h in _HINTS) else ():
        if m.end() <= walked:
            continue
        walked = _REST.match(text, m.end()).end()
        if between := _BETWEEN.match(text, walked):
            if between.end() >= end:  # else it lies in the string before and ends there too
                end = _STRING.match(text, between.end()).end()
            out.add((between.end(), end))
    if any(p in text for p in _PREFIXES):
        out |= {m.span() for m in _PREFIXED.finditer(text)}
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, per_char: float, around: int) -> list[tuple[int, int, str]]:
    """Candidates outside the base spans that hold a digit and add ``per_char`` bytes a character or more.

    A candidate that holds others up to its end is measured in the parts that they
    make, each after its own surroundings, so no part is measured twice.
    """
    found, parts = candidates(text), []
    for k in range(len(found) - 1, -1, -1):
        a, b = found[k]
        inner = k + 1 < len(found) and found[k + 1][0] < b == found[k + 1][1]
        parts.append(found[k + 1][0] if inner else b)
    parts.reverse()
    out, covered, digit, first, cost, measured = [], -1, -1, 0, {}, 0
    for k, (a, b) in enumerate(found):
        if digit < a:
            at = _DIGIT.search(text, a)
            digit = at.start() if at else len(text)
        while first < len(base) and base[first][1] <= a:
            first += 1
        if a < covered or digit >= b or first < len(base) and base[first][0] < b:
            continue
        if k >= measured:  # all parts of this string
            last = k
            while parts[last] < b:
                last += 1
            upto = 0
            for j in range(last, k - 1, -1):
                x, y = found[j][0], parts[j]
                upto += novelty.bytes(text[max(0, x - around) : x], text[x:y], text[y : y + around])
                cost[j] = upto
            measured = last + 1
        if cost[k] >= per_char * (b - a):
            out.append((a, b, "novel"))
            covered = b
    return out


def find(text: str | None, novelty: Novelty, per_char: float = 0.6, around: int = 256) -> tuple[list, list]:
    """Base spans and all spans of one whole text; null counts as empty."""
    if not text:
        return [], []
    base = base_spans(text)
    more = novel_spans(text, base, novelty, per_char, around)
    every = sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base
    return base, every


def scan(docs: DataFrame, known: str, per_char: float = 0.6, around: int = 256) -> DataFrame:
    """doc_id, text and the spans found: base and spans, both arrays of (start, end, kind), ends exclusive, in code points.

    ``known`` is the dictionary that identifiers() gives.  One row for each row of
    ``docs``: null and empty texts have no spans, equal rows give equal ones, an
    empty table gives no rows; a very long text is searched once from end to end;
    other columns are dropped, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        named = lambda xs: [[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in xs]
        for batch in batches:
            found = [find(t, novelty, per_char, around) for t in batch["text"].to_pylist()]
            base, every = pa.array(named([x for x, _ in found]), kind), pa.array(named([x for _, x in found]), kind)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], base, every], ["doc_id", "text", "base", "spans"])

    span = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(afresh(run), f"doc_id long, text string, base {span}, spans {span}")


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each found stretch (overlaps joined) replaced by one mark."""
    if not spans or text is None:
        return text
    joined: list[list[int]] = []
    for a, b, _ in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, at = [], 0
    for a, b in joined:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, known: str, text: str = "text", per_char: float = 0.6, around: int = 256) -> DataFrame:
    """``docs``, all columns kept, with secrets in ``text`` replaced; rows without any, null and empty texts stay as they are."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = pa.array([redacted(t, find(t, novelty, per_char, around)[1]) for t in texts], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(afresh(run), docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document: a row for each row, null and empty texts with none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    got = scan(docs, identifiers(docs))
    return got.select("doc_id", *map(count, KINDS[:3]), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
