"""Pages as markdown: fonts to heading levels, lines to styled text, tables and images put where they belong.

Input are tables: lines (doc, page, line, x0, y0, x1, y1, block, spans: array of
(text, size, flags, font, x0, y0, x1, y1)), tables (doc, page, tab, rect,
markdown), images (doc, page, image, rect, name), links (doc, page, rect, uri).  A page is
bounded, so one row holds one, and a batch of pages is rendered at a time; fonts are
counted over whole documents by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbered headings, the deepest first; bullets; flags of a span.
NUMBERED = ((r"\d{1,2}\.\d{1,2}\.\d{1,2}.+", 3), (r"\d{1,2}\.\d{1,2}.+", 2), (r"\d{1,2}\s[^\./].+", 1))
BULLETS = ("- ", "* ", "•", "", "", "●")
SUPERSCRIPT, ITALIC, MONO, BOLD = 1, 2, 8, 16


def numbered_level(text: Column, font: Column | None = None, size: Column | None = None, body: Column | None = None) -> Column:
    """1 to 3 for a text that starts like a numbered heading, else 0; with a font only a bold one counts, with a size only the body's or more."""
    got = F.lit(0)
    for pattern, level in reversed(NUMBERED):
        got = F.when(text.rlike(f"^{pattern}"), level).otherwise(got)
    if font is not None:
        got = F.when(F.coalesce(font, F.lit("")).contains("BOLD") | (F.coalesce(font, F.lit("")) == ""), got).otherwise(0)
    if size is not None and body is not None:
        got = F.when((F.coalesce(size, F.lit(0)) != 0) & (size < body), 0).otherwise(got)
    return got


def _level_of(text: str, font: str | None, size: float | None, body: float) -> int:
    if (size and size < body) or (font and "BOLD" not in font):
        return 0
    return next((n for p, n in NUMBERED if re.match(p, text)), 0)


def fonts(lines: DataFrame) -> DataFrame:
    """doc, ident, size, flags, font, numbered, n_chars, n, first: the styles of a document's lines, told by their first spans.

    ``first`` is where a style is met first; it settles ties where styles are put in order.
    """
    text = F.array_join(F.transform("spans", lambda s: s["text"]), " ")
    one = F.col("spans")[0]
    rows = lines.where(F.size("spans") > 0).select("doc", F.round(one["size"]).cast("int").alias("size"), one["flags"].alias("flags"), one["font"].alias("font"), numbered_level(text).alias("numbered"), F.length(F.trim(text)).alias("chars"), F.struct("page", "line").alias("at"))
    ident = F.concat_ws("_", "size", "flags", "font", "numbered")
    return rows.groupBy("doc", "size", "flags", "font", "numbered").agg(F.sum("chars").alias("n_chars"), F.count("*").alias("n"), F.min("at").alias("first")).withColumn("ident", ident)


def header_info(styles: DataFrame, body_limit: int = 10, largest: int = 30) -> DataFrame:
    """doc, body, sizes (up to three, the largest first), by_size: how a document shows its headings.

    The body is the style with most characters of ``body_limit`` or more.  For each of
    three levels the style that stands for its size is weighed against the one that
    stands for its number (level 2 needs 1, 3 both); sizes win if they win more levels.
    """
    doc = W.partitionBy("doc")
    ranked = styles.withColumn("_by_chars", F.row_number().over(doc.orderBy(F.desc("n_chars"), "first")))
    body = F.min_by("size", F.when(F.col("size") >= body_limit, F.col("_by_chars"))).over(doc)
    ranked = ranked.withColumn("body", F.coalesce(body, F.lit(body_limit)))
    ranked = ranked.withColumn("_large", (F.col("size") > F.col("body")) & (F.col("size") <= largest))
    # of each size the style met first, sizes downwards
    order = F.struct(F.negative("size").alias("size"), F.col("first").alias("first"))
    by = ranked.groupBy("doc").agg(
        F.first("body").alias("body"),
        F.sort_array(F.collect_list(F.when(F.col("_large"), F.struct(order.alias("o"), "size", "n_chars")))).alias("_sizes"),
        *[F.min_by("n_chars", F.when(F.col("numbered") == k, order)).alias(f"_num{k}") for k in (1, 2, 3)],
        *[F.min(F.when(F.col("numbered") == k, order)).alias(f"_at{k}") for k in (1, 2, 3)],
    )
    sizes = F.filter("_sizes", lambda s, i: (i == 0) | (F.get("_sizes", i - 1)["size"] != s["size"]))
    by = by.withColumn("_top", F.slice(sizes, 1, 3))
    two = F.when((F.col("_at1") < F.col("_at2")), F.col("_num2"))
    three = F.when((F.col("_at1") < F.col("_at2")) & (F.col("_at2") < F.col("_at3")), F.col("_num3"))
    votes = F.lit(0)
    for k, number in enumerate((F.col("_num1"), two, three)):
        size = F.get("_top", F.lit(k))["n_chars"]
        votes = votes + F.when(size.isNotNull() & number.isNotNull(), F.when(size > number, 1).otherwise(-1)).when(size.isNotNull(), 1).when(number.isNotNull(), -1).otherwise(0)
    return by.select("doc", "body", F.transform("_top", lambda s: s["size"]).alias("sizes"), (votes > 0).alias("by_size"))


def prefix(text: str, span: dict, info: dict) -> str:
    """The ``#`` marks of a line, by number or by size."""
    if info["by_size"]:
        size = round(span["size"])
        sizes = list(info["sizes"] if info["sizes"] is not None else [])
        return "#" * (sizes.index(size) + 1) + " " if size in sizes else ""
    level = _level_of(text, span["font"], span["size"], info["body"])
    return "#" * level + " " if level else ""


def middle_in(a: dict, b: dict) -> bool:
    """Whether the middle of a lies in b."""
    return b["x0"] <= (a["x0"] + a["x1"]) / 2 <= b["x1"] and b["y0"] <= (a["y0"] + a["y1"]) / 2 <= b["y1"]


def linked(span: dict, links: list[dict]) -> str | None:
    """The span as a markdown link, if a link's middle lies in it."""
    return next((f"[{span['text'].strip()}]({k['uri']})" for k in links if middle_in(k["rect"], span)), None)


def styled(span: dict, links: list[dict]) -> str:
    """A span with its marks: mono, bold, italic, link, bullet."""
    if span["flags"] & MONO:
        return f"`{span['text'].strip()}` "
    before = ("**" if span["flags"] & BOLD else "") + ("_" if span["flags"] & ITALIC else "")
    text = f"{before}{linked(span, links) or span['text'].strip()}{before[::-1]} "
    return "-  " + text[1:] if text.startswith(BULLETS) else text


def render(page: dict, left: float = 0.0) -> str:
    """One page (lines, tables, images, links, info): what stands above a line comes before it, the rest at the end."""
    waiting = sorted([(t["rect"]["y1"], t["rect"]["x0"], k, f"\n{t['markdown']}\n") for k, t in enumerate(page["tables"])] + [(i["rect"]["y1"], i["rect"]["x0"], k, f"\n![{i['name']}]({i['name']})\n") for k, i in enumerate(page["images"])])
    covered = [x["rect"] for x in (*page["tables"], *page["images"])]
    out: list[str] = []
    state = {"block": -1, "line": None, "code": False, "header": ""}
    for line in page["lines"]:
        spans = list(line["spans"])
        if not spans or any(middle_in(line, r) for r in covered):
            continue
        while waiting and waiting[0][0] <= line["y0"]:
            out.append(waiting.pop(0)[3])
        out.append(_line(line, spans, page, state, out, left))
    body = "".join(out) + "\n" + ("```\n" if state["code"] else "")
    body = body.replace(" \n", "\n").replace("  ", " ").replace("\n\n\n", "\n\n") + "".join(w[3] for w in waiting)
    return tidy(body)


def _line(line: dict, spans: list[dict], page: dict, state: dict, out: list[str], left: float) -> str:
    text, first, got = " ".join(s["text"] for s in spans), spans[0], ""
    if all(s["flags"] & MONO for s in spans):
        got = "" if state["code"] else "```\n"
        state["code"] = True
        return got + " " * int((line["x0"] - left) / (first["size"] * 0.5)) + text + "\n"
    if line["block"] != state["block"]:
        got += "\n"
        state["block"] = line["block"]
    before = state["line"]
    far = before is not None and line["y1"] - before["y1"] > (line["y1"] - line["y0"]) * 1.5
    if far or first["text"].startswith(("[", *BULLETS)) or first["flags"] & SUPERSCRIPT:
        got += "\n"
    state["line"] = line
    mark = prefix(text, first, page["info"])
    if mark and mark == state["header"]:  # a heading over several lines
        joined = ("".join(out) + got)[:-1] + " " + text + "\n"
        out.clear()
        return joined
    state["header"] = mark
    if mark:
        return got + mark + text + "\n"
    if state["code"]:
        got += "```\n"
        state["code"] = False
    return got + "".join(styled(s, page["links"]) for s in spans) + "\n"


def tidy(text: str) -> str:
    """Words that a line end cut are whole again; no breaks at the start, no more than one blank line."""
    text = text.replace("-\n", "") if "-\n" in text else text
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.lstrip("\n")


_RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def to_markdown(lines: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, links: DataFrame | None = None, toc: DataFrame | None = None, graphics_limit: int | None = None, pages: list[int] | None = None, **limits) -> DataFrame:
    """doc, page, text of each page with lines, tables or images; with a table of contents (doc, page from 1, level, title) also ``toc_items``.

    ``pages`` keeps those numbers alone.  A page with more images than
    ``graphics_limit`` gets a note for them.
    """
    keep = lambda df: df if pages is None else df.where(F.col("page").isin(pages))
    info = header_info(fonts(lines), **limits)
    line = F.struct("line", "x0", "y0", "x1", "y1", "block", "spans")
    by = keep(lines).groupBy("doc", "page").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def gathered(df: DataFrame | None, name: str, fields: str, kind: str) -> DataFrame:
        nonlocal by
        if df is None:
            return by.withColumn(name, F.array().cast(f"array<struct<{kind}>>"))
        rows = keep(df).groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct(*fields.split()))).alias(f"_{name}"))
        got = by.join(rows, ["doc", "page"], "full" if name != "links" else "left")
        return got.withColumn(name, F.coalesce(f"_{name}", F.array().cast(rows.schema[f"_{name}"].dataType))).drop(f"_{name}")

    by = gathered(tables, "tables", "tab rect markdown", f"tab:int,rect:{_RECT},markdown:string")
    by = gathered(images, "images", "image rect name", f"image:int,rect:{_RECT},name:string")
    by = gathered(links, "links", "rect uri", f"rect:{_RECT},uri:string")
    by = by.withColumn("lines", F.coalesce("lines", F.array().cast(by.schema["lines"].dataType)))
    by = by.join(info, "doc", "left").withColumn("info", F.struct(F.coalesce("body", F.lit(limits.get("body_limit", 10))).alias("body"), "sizes", F.coalesce("by_size", F.lit(False)).alias("by_size")))
    crowded = F.lit(False) if graphics_limit is None else F.size("images") > graphics_limit
    by = by.withColumn("crowded", crowded).withColumn("images", F.when(F.col("crowded"), F.slice("images", 1, 0)).otherwise(F.col("images")))
    names = ["lines", "tables", "images", "links", "info"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            note = "\n**Ignoring page with too many graphics**\n"
            text = [(note if r["crowded"] else "") + render({k: r[k] for k in names}) for r in rows]
            yield pd.DataFrame({"doc": batch["doc"], "page": batch["page"], "text": text})

    kinds = dict(by.dtypes)
    got = by.select("doc", "page", "crowded", *names).mapInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, text string")
    if toc is None:
        return got
    items = toc.groupBy("doc", (F.col("page") - 1).cast(kinds["page"]).alias("page")).agg(F.sort_array(F.collect_list(F.struct("level", "title"))).alias("toc_items"))
    return got.join(items, ["doc", "page"], "left")


def whole_document(pages: DataFrame, separator: str = "\n-----\n\n") -> DataFrame:
    """doc, text: the pages in order."""
    one = F.sort_array(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(one, lambda p: p["text"]), separator).alias("text"))


def margins(value) -> tuple[float, float, float, float]:
    """One number for all sides, two for top and bottom, or four; anything else is an error."""
    got = [value] * 4 if isinstance(value, (int, float)) else list(value)
    got = [0, got[0], 0, got[1]] if len(got) == 2 else got
    if len(got) != 4 or not all(isinstance(m, (int, float)) for m in got):
        raise ValueError("margins are one, two or four numbers")
    return tuple(float(m) for m in got)


def page_lines(text: Column) -> Column:
    """Lines of a page's text for header and footer scores: blank lines become breaks first."""
    return F.split(F.replace(F.replace(text, F.lit("\n\n"), F.lit("  \n")), F.lit("\n\n"), F.lit("\n")), "\n")


def merged_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def significant(paths: DataFrame, clusters: DataFrame, pages: DataFrame, edge: float = 36.0, least: float = 20.0) -> DataFrame:
    """Clusters (doc, page, cluster, x0, y0, x1, y1) that show something: within the page's margins, high enough, and with a stroked point off their border.

    ``paths`` (doc, page, x, y) are stroked points, ``pages`` (doc, page, x0, y0, x1, y1).
    """
    p = pages.select("doc", "page", *[F.col(k).alias(f"p_{k}") for k in ("x0", "y0", "x1", "y1")])
    got = clusters.join(p, ["doc", "page"])
    got = got.where((F.col("x0") >= F.col("p_x0") + edge) & (F.col("y0") >= F.col("p_y0") + edge) & (F.col("x1") <= F.col("p_x1") - edge) & (F.col("y1") <= F.col("p_y1") - edge) & (F.col("y1") - F.col("y0") > least))
    inside = (F.col("c.doc") == F.col("q.doc")) & (F.col("c.page") == F.col("q.page")) & (F.col("q.x") > F.col("c.x0")) & (F.col("q.x") < F.col("c.x1")) & (F.col("q.y") > F.col("c.y0")) & (F.col("q.y") < F.col("c.y1"))
    return got.select(*clusters.columns).alias("c").join(paths.alias("q"), inside, "left_semi")
