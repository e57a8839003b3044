"""Scalar functions as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines of a text, without an empty last one; null gives none."""
    got = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(got, -1) == "", F.slice(got, 1, F.size(got) - 1)).otherwise(got)


def norm_text(c: Column) -> Column:
    """Lower case, single spaces, then only letters, digits, underscores and spaces."""
    spaced = F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)[^\p{L}\p{N}_\s]", ""))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([_\[\]()~`>#+\-=|{}.!\\])", r"\\$1")


def uuid_from(c: Column) -> Column:
    """A UUID made of the text's md5."""
    return F.regexp_replace(F.md5(c), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def content_hash(*cs: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]), 256)


def file_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def safe_int(c: Column, default: int) -> Column:
    """A whole number of any length that a long holds, white space around it aside; anything else is the default."""
    return F.coalesce(F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("long")), F.lit(default).cast("long"))


def stripped_of(c: Column, characters: str) -> Column:
    """Without any of the characters at both ends."""
    return F.btrim(c, F.lit(characters))


def json_text(c: Column) -> Column:
    """A struct, array or map as JSON, indented."""
    return F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"})


def rgb(c: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue shares of a 24-bit colour."""
    byte = lambda k: F.shiftright(c, k).bitwiseAND(255) / 255.0
    return byte(16), byte(8), byte(0)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"^(?s:{out})$"


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for zero vectors."""
    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(da, da)) * F.sqrt(dot(db, db))
    return F.when(norm > 0, dot(da, db) / norm)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def is_watermark(text: Column, short: str, long: str) -> Column:
    """Whether the text, digits and breaks removed, is part of the long mark or holds the short one."""
    bare = F.regexp_replace(text, "[\\d​\n]", "")
    no_digits = lambda s: re.sub(r"\d", "", s)
    return F.lit(no_digits(long)).contains(bare) | bare.contains(no_digits(short))


def positional_match(a: Column, b: Column) -> Column:
    """Share of places with the same character, numbers of one to four digits counted as one mark; null if both are empty."""
    mark = lambda c: F.regexp_replace(c, r"\d{1,4}", "@")
    x, y = F.split(mark(a), ""), F.split(mark(b), "")
    lx, ly = F.length(mark(a)), F.length(mark(b))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "")), lambda v: v))
    return F.when(F.greatest(lx, ly) > 0, same / F.greatest(lx, ly))


#: The patterns of the cleaning chain, in order.
CONFIDENTIAL = r"(Confidential. [ ]*A[ ]*ll r)(\D+)(authoritative and controlling.)"
PERSON = r"[a-zA-Z0-9_\.@]+ [a-zA-Z0-9_\.@]+\s*[A-Za-z0-9\._%-]+@\s*[A-Za-z0-9\.-]+\.com [0-9]{8}"
AFTER_PERSON = (
    (r"[\.]{4}", ""),
    (r"( \.){2,}", " ."),
    (r"\n +\n", "\n"),
    (r"\n\n+", "\n"),
    (r"((\s*undefined)\s(undefined\s*))+", "\n undefined \n"),
    (r"(?<!.)( )*(```)*xls\([ ]*[\"'].+[\"'][ ]*\)\n", ""),
    (r"(?<!.)\[.*[\.]md[ ]*\](\n)", ""),
)


#: PERSON with the same matches, tried once a word: a match can only begin where a run of its first class does, or where
#: the one before ended, and an "@" must follow the second word or the one after it.
_PERSON_FAST = r"(?:(?<![a-zA-Z0-9_.@])|\G)[a-zA-Z0-9_.@]++ (?=[a-zA-Z0-9_.%-]*+(?:@|\s++[A-Za-z0-9._%-]*+@))" + PERSON.partition(" ")[2]


def _without_persons(c: Column) -> Column:
    """Found tuples and the parts between are looked up by a lambda's argument, so the pattern runs twice over a text, not for each use."""
    both = F.array(F.struct(c.alias("text"), F.regexp_extract_all(c, F.lit(f"({_PERSON_FAST})"), 1).alias("found"), F.split(c, _PERSON_FAST).alias("parts")))

    def one(x: Column) -> Column:
        found, parts = x["found"], x["parts"]
        n = F.size(found)
        kept = F.concat(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), ""), F.element_at(found, -1), F.element_at(parts, -1))
        return F.when(n == 0, x["text"]).when(n == 1, F.array_join(parts, "")).otherwise(kept)

    return F.element_at(F.transform(both, one), 1)


def clean_text(c: Column) -> Column:
    """The cleaning chain: marks, the confidentiality block, personal tuples, dots, blank lines, repeats, lone references.

    One personal tuple goes; of several the last one stays.
    """
    c = F.regexp_replace(F.regexp_replace(c, "\u200b", ""), CONFIDENTIAL, "")
    # most texts have no such tuple: a mark, .com and eight digits tell that before the pattern walks the words
    may = c.contains("@") & c.rlike(r"\.com [0-9]{8}")
    c = F.when(may, _without_persons(c)).otherwise(c)
    for pattern, new in AFTER_PERSON:
        c = F.regexp_replace(c, pattern, new)
    return c
