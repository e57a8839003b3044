"""Trees of linked markdown files as sections: headings of a file, files that its ``[!child.md]`` lines name, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, uuid_from
from ..session import kept


def normal_path(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def outline(files: DataFrame) -> DataFrame:
    """path, pos, kind, level, title, link, body of each line of the files (path, text).

    A heading has one to three ``#`` (more count as three), with or without a blank
    behind them; fences don't matter.  Links are relative to the file.
    """
    rows = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    line, marks = F.col("line"), F.length(F.regexp_extract("line", "^#*", 0))
    target = strip(F.regexp_replace(strip(line), r"^[\[\]!]+|[\[\]!]+$", ""))
    link = F.when(line.startswith("[!") & (marks == 0), normal_path(F.when(target.startswith("/"), target).otherwise(F.concat(folder_of(F.col("path")), F.lit("/"), target))))
    body = strip(F.regexp_replace(line, "^-+|-+$", ""))
    return rows.select(
        "path", "pos", F.least(marks, F.lit(3)).alias("level"), F.when(marks > 0, strip(F.regexp_replace(line, "^#+", ""))).alias("title"), link.alias("link"),
        F.when((marks == 0) & link.isNull() & (body != ""), body).alias("body"),
    )


def _headed(rows: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Adds h1 to h3 of each line, from the headings before it and what the file inherits (p1 to p3), and its section."""
    upto = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    level = F.col("level")
    carried = lambda k: F.coalesce(F.last(F.when(level == k, F.col("title")).when(level.between(1, k - 1), F.lit("")), True).over(upto), F.col(f"p{k}"))
    rows = rows.withColumns({f"h{k}": carried(k) for k in (1, 2, 3)})
    own = F.concat(F.lit("h"), level.cast("string"), F.lit("_"), F.col("title"))
    return rows.withColumn("section", F.coalesce(F.last(F.when(level > 0, own), True).over(upto), F.col("root_id")))


def section_tree(files: DataFrame, starts: DataFrame) -> DataFrame:
    """Sections of the trees that begin at the files ``starts`` (path): start, id, uuid, place, path, level, h1, h2, h3, text.

    Files are read level by level; a file inherits the headings of the section that
    names it.  A file that is named again is read again, but not inside itself, so
    cycles end.  Links to files that aren't there are left out.  Sections of a tree
    that share an id are one: the last of them, at the place of the first.  Sections
    without text are left out.
    """
    lines = kept(outline(files), "outline")
    known = files.select("path").distinct()
    base = F.concat(F.lit("root_"), F.element_at(F.split("path", "/"), -1))
    none = F.lit("")
    walk = starts.select("path").distinct().join(known, "path").select(F.col("path").alias("start"), "path", F.array(F.lit(0)).alias("at"), F.array("path").alias("chain"), base.alias("root_id"), none.alias("p1"), none.alias("p2"), none.alias("p3"))
    found = None
    while True:
        rows = walk.join(lines, "path")
        rows = kept(_headed(rows, ("start", "at"), "pos"), "sections")
        found = rows if found is None else found.unionByName(rows)
        links = rows.where("link is not null").join(known.withColumnRenamed("path", "link"), "link").where(~F.array_contains("chain", F.col("link")))
        walk = links.select("start", F.col("link").alias("path"), F.concat("at", F.array("pos")).alias("at"), F.concat("chain", F.array("link")).alias("chain"), F.concat("section", F.lit("_sub")).alias("root_id"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("h3").alias("p3"))
        walk = kept(walk, "frontier")
        if walk.isEmpty():
            break
    # a line's place in the whole: the lines that led to its file, then its own; a section begins at its heading or its file
    found = found.withColumn("where", F.concat("at", F.array("pos")))
    heading = F.when(F.col("level") > 0, F.col("where")).when(F.col("pos") == 0, F.col("at"))
    begins = F.last(heading, True).over(W.partitionBy("start", "at").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumn("begins", begins)
    one = F.struct("where", "body")
    section = found.groupBy("start", "section", "begins", "path").agg(
        F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), one))).alias("parts"), F.min(F.struct("where", "h1", "h2", "h3")).alias("heads"), F.max(F.when(F.col("level") > 0, F.col("level"))).alias("level")
    )
    latest = W.partitionBy("start", "section")
    section = section.withColumn("_first", F.min("begins").over(latest)).withColumn("_last", F.max("begins").over(latest)).where("begins = _last")
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    got = section.select("start", F.col("section").alias("id"), uuid_from(F.col("section")).alias("uuid"), F.col("_first").alias("place"), "path", F.coalesce("level", F.lit(0)).cast("string").alias("level"), "heads.h1", "heads.h2", "heads.h3", text.alias("text"))
    return got.where("text <> ''")
