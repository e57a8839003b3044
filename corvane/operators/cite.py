"""Citations: numbering sources, finding numbers in answers, telling what they stand for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import escape_markdown

#: Fixed value: a number in brackets at the end of a sentence, of the text, or before another one.
CITATION = r"\[(\d+)\](?=[.?!]|$|\[\d+\])"


def label_sources(rows: DataFrame, key: str, order: str = "pos", text: str = "text") -> DataFrame:
    """Adds source_no and labels texts by it, but for those that are labelled already."""
    rows = rows.withColumn("source_no", F.row_number().over(W.partitionBy(key).orderBy(order)))
    labelled = F.concat(F.lit("Source "), F.col("source_no").cast("string"), F.lit(":\n"), F.col(text), F.lit("\n"))
    return rows.withColumn(text, F.when(F.col(text).startswith("Source"), F.col(text)).otherwise(labelled))


def cited(answer: Column) -> Column:
    """Distinct cited numbers in order; null if there are none."""
    got = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda n: n.cast("int"))))
    return F.when(F.size(got) > 0, got)


def detail(number: Column, path: Column, text: Column, h1: Column, h2: Column, h3: Column, root: str = "LLM") -> Column:
    """The lines that tell a source."""
    place = F.instr(path, root)
    sub = F.when(place > 0, F.substring(path, place + len(root), F.lit(1 << 30))).otherwise(path)
    head = lambda n, c: F.when(F.length(c) > 0, F.concat(F.lit(f"\n**Heading {n}:** "), c, F.lit("  "))).otherwise("")
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("]  \n**Directory:** "), sub, F.lit("  \n**Text:** "), text, F.lit("  "),
        F.lit("\n**Heading 1:** "), F.coalesce(h1, F.lit("")), F.lit("  "), head(2, F.coalesce(h2, F.lit(""))), head(3, F.coalesce(h3, F.lit(""))),
    )


def details(answers: DataFrame, sources: DataFrame, key: str = "key") -> DataFrame:
    """key, number, detail for each cited source: answers (key, answer), sources (key, source_no, path, text, h1, h2, h3; l1, if there is one, comes before h1).

    Numbers count from 1; 0 is the last source; numbers beyond the sources find none.
    """
    asked = answers.select(key, F.explode(cited(F.col("answer"))).alias("number"))
    last = sources.groupBy(key).agg(F.max("source_no").alias("_n"))
    asked = asked.join(last, key).withColumn("source_no", F.when(F.col("number") == 0, F.col("_n")).otherwise(F.col("number")))
    got = asked.join(sources, [key, "source_no"])
    h1 = first_filled(F.col("l1"), F.col("h1")) if "l1" in sources.columns else F.col("h1")
    return got.select(key, "number", detail(F.col("number"), F.col("path"), F.col("text"), h1, F.col("h2"), F.col("h3")).alias("detail"))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def told(question: Column, answer: Column, cites: Column, final: Column) -> Column:
    """The markdown of one answer: question, escaped answer and its citations (an array), a part of the way or the last."""
    kind = F.when(final, "Final").otherwise("Sub")
    listed = escape_markdown(F.array_join(F.transform(cites, lambda c: F.concat(F.lit("- "), c)), "\n"))
    listed = F.when(F.size(cites) > 0, listed).otherwise("There were no citations.")
    return F.concat(F.lit("\n### "), kind, F.lit("-Question:\n"), question, F.lit("\n\n### "), kind, F.lit("-Answer:\n"), escape_markdown(answer), F.lit("\n\n### Citations\n"), listed, F.lit("\n"))


def merge_history(history: DataFrame, found: DataFrame, key: str = "key", html: bool = False) -> DataFrame:
    """One text of a history (hist, pos, key, question, answer): parts with citations (key, number, detail), and the last part always; breaks are blanks."""
    one = F.sort_array(F.collect_list(F.struct("number", "detail")))
    by = found.groupBy(key).agg(F.transform(one, lambda x: x["detail"]).alias("cites"))
    rows = history.join(by, key, "left").withColumn("_last", F.col("pos") == F.max("pos").over(W.partitionBy("hist")))
    rows = rows.where(F.col("cites").isNotNull() | F.col("_last"))
    part = told(F.col("question"), F.col("answer"), F.coalesce("cites", F.array().cast("array<string>")), F.col("_last"))
    rows = rows.withColumn("part", F.regexp_replace(as_html(part) if html else part, "\n", " "))
    return rows.groupBy("hist").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ").alias("text"))


_INLINE = ((re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'), (re.compile(r"\\([_\[\]()~`>#+\-=|{}.!\\*])"), r"\1"))


def html_of(markdown: str | None) -> str | None:
    """Headings, lists, paragraphs, strong text, code, links and escapes as HTML; other text as it is."""
    if markdown is None:
        return None
    out, paragraph, items = [], [], []

    def inline(text: str) -> str:
        for pattern, new in _INLINE:
            text = pattern.sub(new, text)
        return text

    def flush() -> None:
        if paragraph:
            out.append(f"<p>{inline(chr(10).join(paragraph))}</p>")
        if items:
            out.append("<ul>\n" + "\n".join(f"<li>{inline(i)}</li>" for i in items) + "\n</ul>")
        paragraph.clear()
        items.clear()

    for line in markdown.split("\n"):
        if m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*$", line):
            flush()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"\s{0,3}[-*+]\s+(.*)", line):
            if paragraph:
                flush()
            items.append(m[1])
        elif not line.strip():
            flush()
        elif items:
            items[-1] += "\n" + line.strip()
        else:
            paragraph.append(line.strip())
    flush()
    return "\n".join(out) + "\n"


def as_html(c: Column) -> Column:
    """html_of() of a column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(html_of)

    return run(c)
