"""Structure rules: checking, merging and applying them to lines of text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines, strip
from ..plans import prompts

#: Rules that always hold, and those of one document class.
GENERIC = (
    {"type": "regex_replace", "pattern": r"^>\s?", "replacement": "", "source": "static_generic", "priority": 10},
    {"type": "regex_replace", "pattern": r"^(\s*)\(?(\d+)\)\s+", "replacement": r"\1\2. ", "source": "static_generic", "priority": 20},
)
BY_CLASS = {
    "eu_regulation": (
        {"type": "heading", "pattern": r"^CHAPTER\s+[IVXLCM\d]+\b", "level": 1, "source": "static_eu_regulation", "priority": 110},
        {"type": "heading", "pattern": r"^\s*Article\s+\d+\s*", "level": 2, "source": "static_eu_regulation", "priority": 130},
    )
}
#: Lines that show a document's structure.
SIGNALS = (
    r"^\s*>?\s*Article\s+\d+\b", r"^\s*>?\s*CHAPTER\s+[IVXLCM\d]+\b", r"^\s*>?\s*Section\s+\d+\b", r"^\s*\(?\d+\)\s+", r"^\s*\d+\.\s+",
    r"^\s*>", r"^\s*#{1,6}\s+", r"^Whereas:$", r"^[A-Z][A-Z\s,\-()0-9]{10,}$",
)


def problem(rule: dict) -> str | None:
    """Why a rule can't be used, or None."""
    if not isinstance(rule, dict):
        return "rule"
    kind, pattern = rule.get("type"), rule.get("pattern")
    if kind not in ("heading", "regex_replace"):
        return "type"
    if not pattern:
        return "pattern"
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        return "pattern"
    if kind == "heading":
        level = rule.get("level")
        return None if isinstance(level, int) and 1 <= level <= 6 else "level"
    new = rule.get("replacement")
    if new is None or "$" in new:
        return "replacement"
    return "digits" if new == "" and r"\d" in pattern else None


def checked(profile: dict, rules: str = "rules", needs: tuple[str, ...] = ()) -> dict:
    """The profile itself, if it has what it needs and all its rules can be used; else ValueError."""
    if not isinstance(profile, dict):
        raise ValueError("a profile is an object")
    for name in (*needs, rules):
        if name not in profile:
            raise ValueError(f"the profile lacks {name!r}")
    if not isinstance(profile[rules], list):
        raise ValueError(f"{rules!r} is no list")
    for i, rule in enumerate(profile[rules]):
        if why := problem(rule):
            raise ValueError(f"rule {i}: {why}")
    return profile


def python_replacement(new: str) -> str:
    """``$1`` as Python writes it."""
    return re.sub(r"\$(\d+)", r"\\\1", new)


def merge(document_class: str, own: list[dict]) -> list[dict]:
    """Generic, class and own rules by priority (own ones 1000 where none), earlier ones first among equals; own ones are from "ai"."""
    every = [*GENERIC, *BY_CLASS.get(document_class, ()), *({"priority": 1000, **r, "source": "ai"} for r in own)]
    return sorted((dict(r) for r in every), key=lambda r: int(r.get("priority", 1000)))


def merged_profile(found: dict) -> dict:
    """The profile a model found (document_type, document_class, discovered_rules), with the rules that hold anyway."""
    kind = found.get("document_class", "generic")
    own = [{**r, "replacement": python_replacement(r["replacement"])} if isinstance(r.get("replacement"), str) else r for r in found.get("discovered_rules", [])]
    return {"document_type": found.get("document_type", "unknown"), "document_class": kind, "confidence": found.get("confidence", 0.0), "rules": merge(kind, own), "ai_profile": found}


def parse_profile(reply: str) -> dict:
    """The JSON object of a reply, code fences around it removed; anything else is a ValueError."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip())
    return json.loads(bare)


def generate_profile(text: str, model: Callable[[str], str], known: list[dict] | None = None, review: bool = True) -> dict:
    """A profile of a text: the model sees a sample and the known rules, its own rules are checked and merged, and it reviews the whole.

    Without a review exact repeats go.  What the review leaves out of the four head
    fields is filled in.
    """
    first = prompts.fill(prompts.PROFILE, existing_rules_json=json.dumps(known or [dict(r) for r in GENERIC], indent=2), document_text=sample_text(text))
    found = checked(parse_profile(model(first)), "discovered_rules", ("document_type", "document_class"))
    whole = checked(merged_profile(found))
    if not review:
        seen = [json.dumps(r, sort_keys=True) for r in whole["rules"]]
        return {**whole, "rules": [r for i, r in enumerate(whole["rules"]) if seen[i] not in seen[:i]]}
    second = parse_profile(model(prompts.fill(prompts.REVIEW, profile_json=json.dumps(whole, indent=2))))
    return checked({**{k: whole[k] for k in ("document_type", "document_class", "confidence", "ai_profile")}, **second})


def problem_column(kind: Column, pattern: Column, level: Column, replacement: Column) -> Column:
    """The same check over a table of rules; patterns are not compiled there."""
    return (
        F.when(~F.coalesce(kind, F.lit("")).isin("heading", "regex_replace"), "type").when(F.coalesce(pattern, F.lit("")) == "", "pattern")
        .when((kind == "heading") & ~F.coalesce(level.between(1, 6), F.lit(False)), "level")
        .when((kind == "regex_replace") & (replacement.isNull() | replacement.contains("$")), "replacement")
        .when((kind == "regex_replace") & (replacement == "") & pattern.contains(r"\d"), "digits")
    )


def java_replacement(new: str) -> str:
    """Python's group references as Java's."""
    return re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$"))


def rewrite(line: Column, rules: list[dict]) -> Column:
    """All replacements, in order."""
    for r in rules:
        if r["type"] == "regex_replace":
            line = F.regexp_replace(line, r["pattern"], java_replacement(r["replacement"]))
    return line


def promote(line: Column, rules: list[dict]) -> Column:
    """The first heading rule found in a line makes it a heading; headings and blank lines stay as they are."""
    bare, out = strip(line), F.lit(None).cast("string")
    for r in reversed([r for r in rules if r["type"] == "heading"]):
        out = F.when(bare.rlike(r["pattern"]), F.concat(F.lit("#" * r["level"] + " "), bare)).otherwise(out)
    return F.when((bare == "") | bare.rlike(r"^#{1,6}\s+"), line).otherwise(F.coalesce(out, line))


def apply(docs: DataFrame, rules: list[dict], key: str, text: str = "text") -> DataFrame:
    """key, text: lines rewritten and promoted, runs of blank lines made one, a blank line before each heading."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    rows = rows.withColumn("line", promote(rewrite(F.col("line"), rules), rules))
    rows = collapse_blanks(rows, key)
    rows = blank_before_headings(rows, key)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sub", "line"))), lambda x: x["line"]), "\n").alias(text))


def collapse_blanks(rows: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, line) without blank ones that follow blank ones."""
    order = W.partitionBy(key).orderBy("pos")
    blank = strip(F.col("line")) == ""
    return rows.withColumn("_b", blank).withColumn("_p", F.lag("_b").over(order)).where(~F.col("_b") | ~F.coalesce("_p", F.lit(False))).drop("_b", "_p")


def blank_before_headings(rows: DataFrame, key: str) -> DataFrame:
    """Adds a blank line (sub 0; others 1) before headings that are not first and don't follow one."""
    order = W.partitionBy(key).orderBy("pos")
    before = F.lag("line").over(order)
    rows = rows.withColumn("_add", strip(F.col("line")).rlike(r"^#{1,6}\s+") & before.isNotNull() & (strip(before) != ""))
    both = F.when(F.col("_add"), F.array(F.struct(F.lit(0).alias("sub"), F.lit("").alias("line")), F.struct(F.lit(1).alias("sub"), "line"))).otherwise(F.array(F.struct(F.lit(1).alias("sub"), "line")))
    return rows.select(key, "pos", F.inline(both))


def sample_text(text: str, most: int = 24_000) -> str:
    """sample() of one text in hand."""
    ls = text.splitlines()
    n, told = len(ls), [x for x in ls if any(re.search(p, x) for p in SIGNALS)]
    heads = ("=== BEGINNING ===", "=== STRUCTURAL SIGNALS ===", "=== MIDDLE ===", "=== END ===")
    parts = (ls[:250], told[:500], ls[max(0, n // 2 - 125) : n // 2 + 125], ls[-250:])
    return "\n\n".join("\n".join([h, *p]) for h, p in zip(heads, parts))[:most]


def sample(text: Column, most: int = 24_000) -> Column:
    """Beginning, telling lines, middle and end of a text."""
    ls = lines(text)
    n = F.size(ls)
    telling = F.filter(ls, lambda x: x.rlike("|".join(f"(?:{p})" for p in SIGNALS)))
    first = F.greatest(F.floor(n / 2) - 125, F.lit(0)).cast("int")
    last = (F.floor(n / 2) + 125).cast("int")
    join = lambda c: F.array_join(c, "\n")
    end = F.slice(ls, F.greatest(n - 249, F.lit(1)), F.lit(250))
    whole = F.concat(
        F.lit("=== BEGINNING ===\n"), join(F.slice(ls, 1, 250)), F.lit("\n\n=== STRUCTURAL SIGNALS ===\n"), join(F.slice(telling, 1, 500)),
        F.lit("\n\n=== MIDDLE ===\n"), join(F.slice(ls, first + 1, last - first)), F.lit("\n\n=== END ===\n"), join(end),
    )
    return F.substring(whole, 1, most)


def dump_normalised(rows: DataFrame, folder: str, least: int = 1000) -> None:
    """Writes the texts (path, text) of ``least`` characters and more as Parquet; shorter ones are not worth a file."""
    rows.where(F.length("text") >= least).write.mode("overwrite").parquet(folder)


def heading_column(rules: list[dict], line: Column) -> tuple[Column, Column]:
    """Level and title of a line by heading rules (pattern, level, strip_match), the first that matches at its start; ``#`` lines have neither."""
    level, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for r in reversed(rules):
        at = line.rlike(f"^(?:{r['pattern']})") & ~line.startswith("#")
        text = strip(F.regexp_replace(line, r["pattern"], "")) if r.get("strip_match") else strip(line)
        level, title = F.when(at, F.lit(int(r["level"]))).otherwise(level), F.when(at, text).otherwise(title)
    return level, title
