"""Page layout over tables of spans, lines and rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import positional_match

#: Pages on either side, lines at either end, their weights, and what a header or footer must score.
BAND, EDGE, WEIGHTS, HEADER, FOOTER = 8, 5, (1.0, 0.75, 0.5, 0.5, 0.5), 0.3, 0.5


def font_histogram(spans: DataFrame) -> DataFrame:
    """Characters and spans of each style (size, flags, font), in no order: ident, size, n_chars, n."""
    ident = F.concat_ws("_", F.round("size").cast("int").cast("string"), F.col("flags").cast("string"), "font")
    by = spans.groupBy(ident.alias("ident"), F.round("size").cast("int").alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("n_chars"), F.count("*").alias("n"))
    return by


def heading_sizes(fonts: DataFrame, body_limit: int = 10, largest: int = 30, levels: int = 3) -> DataFrame:
    """size, level: the largest sizes above the body's; the body has the size of ``body_limit`` or more with most characters."""
    by = fonts.groupBy("size").agg(F.sum("n_chars").alias("n_chars"))
    body = by.where(F.col("size") >= body_limit).agg(F.max_by("size", F.struct("n_chars", F.negative("size"))).alias("body"))
    got = by.join(F.broadcast(body), (F.col("size") > F.col("body")) & (F.col("size") <= largest))  # one row
    return got.withColumn("level", F.row_number().over(W.orderBy(F.desc("size")))).where(F.col("level") <= levels).select("size", "level")


def edge_scores(pages: DataFrame, top: bool = True) -> DataFrame:
    """doc, page, slot, line, score, is_edge of the first or last lines of each page (doc, page from 0, lines).

    A line is compared with the lines of its slot on the pages around it; page 0
    is no partner.  Missing lines count as empty ones.
    """
    n = F.size("lines")
    if top:
        five = F.concat(F.slice("lines", 1, EDGE), F.array_repeat(F.lit(""), F.greatest(EDGE - n, F.lit(0))))
    else:
        five = F.concat(F.array_repeat(F.lit(""), F.greatest(EDGE - n, F.lit(0))), F.slice("lines", F.greatest(n - EDGE + 1, F.lit(1)), F.lit(EDGE)))
    cells = pages.select("doc", "page", F.posexplode(five).alias("slot", "line"))
    count = pages.groupBy("doc").agg(F.max("page").alias("last"))
    a, b = cells.join(count, "doc").alias("a"), cells.alias("b")
    # pages meet in blocks as wide as the band, a page with its own block and the next ones on either side
    block = lambda page: F.floor(page / BAND)
    a = a.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("page") - BAND, F.lit(0))), block(F.col("page") + BAND)))).alias("a")
    b = b.withColumn("block", block(F.col("page"))).alias("b")
    near = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.block") == F.col("b.block"))
    near &= (F.col("b.page") >= F.greatest(F.col("a.page") - BAND, F.lit(1))) & (F.col("b.page") < F.least(F.col("a.page") + BAND, F.col("a.last") + 1))
    got = a.join(b, near).groupBy("a.doc", "a.page", "a.slot", "a.line")
    match = positional_match(F.col("a.line"), F.col("b.line"))
    got = got.agg(F.avg(match).alias("mean"), F.max(match.isNull()).alias("both_empty"))
    weights = F.array(*map(F.lit, WEIGHTS if top else WEIGHTS[::-1]))
    weight = F.element_at(weights, F.col("slot") + 1)
    score = F.when(F.col("both_empty"), weight).otherwise(F.col("mean") * weight if top else F.col("mean"))
    return got.select("doc", "page", "slot", "line", F.round(score, 6).alias("score"), (score > (HEADER if top else FOOTER)).alias("is_edge"))


def points_in_rects(points: DataFrame, rects: DataFrame, cell: float = 16.0) -> DataFrame:
    """Pairs of points (page, point, x, y) and rectangles (page, rect, x0, y0, x1, y1) that hold them.

    Both meet in the cells of a grid: a point has one, a rectangle those that it touches.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = rects.where("x0 <= x1 and y0 <= y1").withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    placed = points.withColumns({"cx": at("x"), "cy": at("y")})
    return placed.join(spread, ["page", "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1").select("page", "point", "rect")


def tables_before(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """For each table (page, tab, y1) the first line (page, line, y0, x0) that starts at its end or below; each table once.

    Lines and tables of a page are put in one order, upwards, and the last line
    before a table is its line, so nothing is paired and each row is looked at once.
    A table told more than once ends where the highest of them does; lines and tables
    without a page or a height meet nothing; a line without x0 is the last of its height.
    """
    ends = tables.groupBy("page", "tab").agg(F.min("y1").alias("y"))
    one = lines.select("page", F.col("y0").alias("y"), F.lit(1).alias("kind"), "x0", "line", F.lit(None).cast("long").alias("tab"))
    two = ends.select("page", "y", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("x0"), F.lit(None).cast(dict(lines.dtypes)["line"]).alias("line"), F.col("tab").cast("long").alias("tab"))
    # upwards, as Spark walks a frame that ends at the current row once, and one that starts there anew for each row
    upwards = W.partitionBy("page").orderBy(F.desc("y"), F.desc("kind"), F.desc_nulls_first("x0"), F.desc("line")).rowsBetween(W.unboundedPreceding, 0)
    rows = one.unionByName(two).where("page is not null and y is not null").withColumn("next", F.last("line", ignorenulls=True).over(upwards))
    return rows.where("kind = 0 and next is not null").select("page", F.col("tab").cast(dict(tables.dtypes)["tab"]).alias("tab"), F.col("next").alias("line"))


def in_order(boxes: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Adds ``place``: reading order by lower edge, then left edge."""
    return boxes.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("y1", "x0")))
