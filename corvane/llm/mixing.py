"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  Every document first gets the whole
copies that its source's ratio allows; what is left, the need, is filled by a sample
without replacement in which a document has the probability p = c * favour, with c
such that the expected words are the need.  Documents for which that is 1 or more
are certain: they are taken, and c is worked out again for the others, until none is.
Those are ranked by random odds over inclusion odds, ``u/(1-u) / (p/(1-p))``, and the
ranking is cut where the words taken come closest to the need.

The random number is a hash of doc_id, so reruns agree.  The cut is found as in a
radix selection: words are summed by source and the first BITS bits of the rank, and
only the rows of the one bucket of each source where the cut falls are looked at
again, by their next bits, until all bits are settled.  So a source that holds a
third of all rows isn't sorted in one task.  Rows that are alike in all that ranks
them are counted, and as many of them are taken as are needed.  All of it is
built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, columns, materialised, table, words

#: Bits of the rank that one look settles, and looks.
BITS, LOOKS = 8, 5


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn.  All
    targets together are ``share`` times all sizes; none is above ``limit`` times
    its source's size, and what is cut off goes to the others by weight: target
    = least(limit * size, level * weight) with one level for all.  The sources' rows,
    one each, are ordered in one task: up to some hundred thousand of them.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", limit * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    order = everything.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("total", share * F.sum("source_size").over(everything))
    by = by.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("left") / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the first source that the level doesn't fill sets the level of all behind it
    by = by.withColumn("first", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything))
    level = F.col("first")["level"]
    by = by.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))))
    return by.select("source", "source_size", "target")


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1 from 48 bits of a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _odds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources plus ``left`` (words to be sampled), ``factor`` (c) and ``top`` (documents of a higher favour are certain)."""
    sums = rows.groupBy("source", "favour").agg(F.sum("size").alias("words"))
    down = W.partitionBy("source").orderBy(F.desc("favour"))
    own = sums.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("below", F.sum(F.col("favour") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing)))
    own = own.join(sources.select(F.col("source").alias("_s"), "need"), _same("source", "_s")).drop("_s")
    own = own.withColumn("left", F.col("need") - F.col("above")).withColumn("factor", F.when(F.col("below") > 0, F.col("left") / F.col("below")).otherwise(F.lit(0.0)))
    fits = own.where(F.col("factor") * F.col("favour") < 1).groupBy(F.col("source").alias("_s")).agg(F.max_by(F.struct("left", "factor", F.col("favour").alias("top")), "favour").alias("_o"))
    return sources.join(fits, _same("source", "_s"), "left").select(*sources.columns, "_o.*")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, favour, u, ...) with their source's ``plan``, ``certain``, ``rank`` (0 to 1) and ``code``, its bits."""
    told = plan.select(F.col("source").alias("_s"), F.struct(*[c for c in plan.columns if c != "source"]).alias("plan"))
    got = rows.join(told, _same("source", "_s")).drop("_s")
    p, u = F.col("plan.factor") * F.col("favour"), F.col("u")
    # rank is q / (1 + q) for q = random odds / odds of inclusion, halved: it orders alike; documents without odds come last
    q = (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)
    got = got.withColumn("certain", (F.col("favour") > F.col("plan.top")) & (F.col("plan.need") > 0))
    got = got.withColumn("rank", F.when(p > 0, q / 2).otherwise(0.5 + u / 2))
    return got.withColumn("code", F.least(F.lit((1 << BITS * LOOKS) - 1), F.floor(F.col("rank") * float(1 << BITS * LOOKS))))


def _row() -> Column:
    return F.struct("rank", "doc_id", "size")


def plan(docs: DataFrame, size: Column, favour: Column | None = None, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row for each source: its size and target, the whole copies of each document, the odds, and where the ranking is cut.

    ``size`` and ``favour`` (whole, 0 or more; null: the same for all) are
    expressions over ``docs`` (doc_id, source, ...); the favours of a source have few
    distinct values, some thousand at most.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.cast("long").alias("size"), (F.lit(1) if favour is None else favour).cast("long").alias("favour"), uniform(F.col("doc_id"), seed).alias("u"), F.monotonically_increasing_id().alias("at"))
    base = scratch.kept(base, "mix-sizes")
    by = targets(base, weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.withColumn("whole", F.floor(ratio))
    by = scratch.kept(by.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    by = scratch.kept(_odds(base, by), "mix-odds")
    rows = _ranked(base, by).where("not certain and plan.need > 0").select("source", "doc_id", "size", "rank", "code", "at", F.col("plan.left").alias("left"), F.lit(0).cast("long").alias("before"))
    for look in range(1, LOOKS + 1):
        rows = rows.withColumn("bucket", F.shiftright("code", BITS * (LOOKS - look)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("before"))
        up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("end", F.col("before") + F.sum("words").over(up_to)).where("end >= left and end - words < left")
        cut = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("end") - F.col("words")).alias("_before"))
        rows = rows.join(cut, _same("source", "_s") & (F.col("bucket") == F.col("_b"))).withColumn("before", F.col("_before")).drop("_s", "_b", "_before", "bucket")
        rows = scratch.kept(rows, "mix-bucket")
    # rows of one code; those alike are one row here
    alike = rows.groupBy("source", "rank", "doc_id", "size").agg(F.count("*").alias("rows"), F.first("left").alias("left"), F.first("before").alias("before"))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    alike = alike.withColumn("end", F.col("before") + F.sum(F.col("size") * F.col("rows")).over(order)).withColumn("start", F.col("end") - F.col("size") * F.col("rows"))
    alike = alike.where("start < left and end >= left")  # one key of each source
    full = F.floor((F.col("left") - F.col("start")) / F.col("size"))
    over, under = F.col("start") + (full + 1) * F.col("size") - F.col("left"), F.col("left") - (F.col("start") + full * F.col("size"))
    last = alike.select(F.col("source").alias("_s"), F.struct("rank", "doc_id", "size").alias("cut"), "rows", F.least(F.col("rows"), full + (over < under).cast("long")).alias("take"))
    last = scratch.kept(last, "mix-last")
    # where some of the rows alike are taken, the tasks' counts tell in which task the last one is
    tied = rows.join(last.where("0 < take and take < rows").drop("rows"), _same("source", "_s") & (F.struct("rank", "size") == F.struct("cut.rank", "cut.size")) & F.col("doc_id").eqNullSafe(F.col("cut.doc_id")))
    tied = tied.withColumn("task", F.shiftright("at", 33))
    tasks = tied.groupBy("source", "task").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    tasks = tasks.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, 0))).where("upto >= take and upto - n < take")
    tasks = tasks.select(F.col("source").alias("_s"), F.col("task").alias("_t"), (F.col("take") - F.col("upto") + F.col("n")).alias("nth"))
    inside = tied.drop("_s").join(tasks, _same("source", "_s") & (F.col("task") == F.col("_t")))
    inside = inside.withColumn("k", F.row_number().over(W.partitionBy("source", "task").orderBy("at"))).where("k = nth").select(F.col("source").alias("_u"), F.col("at").alias("cut_at"))
    found = last.join(inside, _same("_s", "_u"), "left").select("_s", "cut", F.when(F.col("take") == 0, F.lit(-1)).when(F.col("take") < F.col("rows"), F.col("cut_at")).otherwise(F.lit((1 << 63) - 1)).alias("cut_at"))
    out = materialised(by.join(found, _same("source", "_s"), "left").drop("_s"), "mix-plan")
    scratch.drop()
    return out


def with_copies(docs: DataFrame, plan: DataFrame, size: Column, favour: Column | None = None, seed: str = "mix") -> DataFrame:
    """doc (all columns of ``docs``), size, copies and plan (the row of its source) of each row of ``docs``.

    ``docs`` is the very table that the plan was made of: rows that are alike are
    told apart by their places in it.  Nothing but the plan's row of a source is
    needed, so documents stay where they are.  Documents of size 0 take nothing that
    counts; of rows with the same doc_id, source and size as many are taken as the
    need asks for; null doc_id and source are values like others; an empty table gives
    no rows; columns may have any names.
    """
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.cast("long").alias("size"), (F.lit(1) if favour is None else favour).cast("long").alias("favour"), uniform(F.col("doc_id"), seed).alias("u"), F.monotonically_increasing_id().alias("at"))
    got = _ranked(rows, plan)
    before = (_row() < F.col("plan.cut")) | ((_row() == F.col("plan.cut")) & (F.col("at") <= F.col("plan.cut_at")))
    # without a cut there is nothing to fill, or all of the source fills it
    more = F.when(F.col("certain"), F.lit(True)).when(F.col("plan.cut").isNull(), F.col("plan.need") > 0).otherwise(F.coalesce(before, F.lit(False)))
    return got.select("doc", "size", (F.col("plan.whole") + more.cast("long")).alias("copies"), "plan")


def favoured(size: Column) -> Column:
    """Documents of few words are taken less often: two hundredths of size / (size + 100)."""
    return F.floor(200 * size / (size + 100))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    size = F.size(words(F.col("text"))).cast("long")
    # word counts are few bytes a document: they are written once, texts are read once
    docs = materialised(table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size")), "mix-words")
    how = plan(docs, F.col("size"), favoured(F.col("size")))
    got = with_copies(docs, how, F.col("size"), favoured(F.col("size")))
    return got.select("doc.doc_id", "size", "plan.source_size", "plan.target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), f AS (
  SELECT *, CAST(floor(200 * size / (size + 100)) AS BIGINT) AS favour,
         (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM f GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), o AS (
  SELECT *, cap / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1), cap)) AS target FROM l
), g AS (
  SELECT source, source_size, target, whole, target - whole * source_size AS need
  FROM (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END) AS whole FROM t)
), h AS (
  SELECT source, favour, coalesce(sum(words) OVER (PARTITION BY source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(favour * words) OVER (PARTITION BY source ORDER BY favour DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below
  FROM (SELECT source, favour, CAST(sum(size) AS BIGINT) AS words FROM f GROUP BY 1, 2)
), o2 AS (
  SELECT h.source, favour AS top, need - above AS rest, CASE WHEN below > 0 THEN CAST(need - above AS DOUBLE) / CAST(below AS DOUBLE) ELSE 0.0::DOUBLE END AS factor FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT source, max_by(top, top) AS top, max_by(rest, top) AS rest, max_by(factor, top) AS factor FROM o2 WHERE factor * top < 1 GROUP BY source
), r AS (
  SELECT f.*, g.source_size, g.target, g.whole, g.need, q.rest, coalesce(favour > q.top, false) AND g.need > 0 AS certain, q.factor * favour AS p
  FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source LEFT JOIN q ON f.source IS NOT DISTINCT FROM q.source
), k AS (
  SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) / 2 ELSE 0.5 + u / 2 END AS rk FROM r
), c AS (
  SELECT *, sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY certain, rk, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN need <= 0 THEN 0 WHEN certain OR upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
