"""Vector top-k and expansion of hits to the articles they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, strip


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "node_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to the query by cosine, ties by id: exact, one scan, a partial top-k in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), F.col(id_col)).limit(k)


def parent_scores(hits: DataFrame, parents: int = 5, parent: str = "parent", id_col: str = "node_id") -> DataFrame:
    """Best score and hits of each parent, the best ``parents`` of them; equal scores by the first hit.

    Hits without a parent are left out.
    """
    order = W.orderBy(F.desc("score"), F.col(id_col))  # over k hits
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col(parent).isNotNull() & (F.col(parent).cast("string") != ""))
    by = ranked.groupBy(parent).agg(
        F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", id_col))).alias("hits")
    )
    return by.orderBy(F.desc("score"), "first_rank").limit(parents)


def siblings(parents: DataFrame, store: DataFrame, parent: str = "parent", order: tuple[Column, ...] = (), most: int | None = None, level: tuple[str, str] | None = None) -> DataFrame:
    """Stored rows of the parents, in order, ``most`` of each; ``level`` (column, value) keeps rows of one level.

    The few parents that parent_scores() leaves are given to all tasks, so the store is scanned once.
    """
    store = store if level is None else store.where(F.col(level[0]) == level[1])
    got = store.join(F.broadcast(parents), parent)
    got = got.withColumn("place", F.row_number().over(W.partitionBy(parent).orderBy(*order)))
    return got if most is None else got.where(F.col("place") <= most)


def sibling_order(index: str = "article_child_index", id_col: str = "node_id") -> tuple[Column, ...]:
    """By index, rows without one last, then by id."""
    return F.coalesce(F.col(index), F.lit(1_000_000_000)), F.col(id_col)


def merged(rows: DataFrame, text: str = "text", parent: str = "parent", id_col: str = "node_id") -> DataFrame:
    """One context for each parent: the first sibling's header lines, then non-empty texts in order, blank lines between.

    The header is header_path, or h1 and h2 where that is empty; rows without those
    columns have none.
    """
    names = [c for c in ("header_path", "h1", "h2") if c in rows.columns]
    parts = F.sort_array(F.collect_list(F.struct("place", text)))
    by = rows.groupBy(parent, "score", "first_rank", "hits").agg(parts.alias("parts"), F.count("*").alias("n_children"), *[F.min_by(c, "place").alias(c) for c in names])
    texts = F.filter(F.transform("parts", lambda p: strip(p[text])), lambda t: t != "")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) if c in names else F.lit("")
    given = lambda *cs: F.concat(F.filter(F.array(*cs), lambda c: c != ""), F.array(F.lit("")))
    head = F.when(full("header_path") != "", given(full("header_path"))).when((full("h1") != "") | (full("h2") != ""), given(full("h1"), full("h2"))).otherwise(F.array().cast("array<string>"))
    ids = F.array_join(F.transform("hits", lambda h: h[id_col].cast("string")), ",")
    return by.select(parent, "score", "first_rank", ids.alias("hit_ids"), "n_children", F.array_join(F.concat(head, texts), "\n\n").alias("context"), F.lit("expanded_article_context").alias("node_level"))


def expand(hits: DataFrame, store: DataFrame, parents: int = 5, most: int | None = None, mode: str = "merged", parent: str = "parent_article", id_col: str = "node_id", level: tuple[str, str] = ("node_level", "paragraph"), index: str = "article_child_index") -> DataFrame:
    """Hits (node_id, parent, score, text) as articles: parent, node_id, score, rank, text, n_children, matched.

    ``merged`` gives a row for each parent, ``siblings`` one for each stored child.  A
    parent without stored children keeps its hits, and hits stay as they are where
    none of them has a parent.
    """
    if mode not in ("merged", "siblings"):
        raise ValueError(f"unknown mode {mode!r}")
    best = parent_scores(hits, parents, parent, id_col).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "first_rank")))
    rows = siblings(best, store, parent, sibling_order(index, id_col), most, level)
    ids = F.transform("hits", lambda h: h[id_col].cast("string"))
    if mode == "merged":
        got = merged(rows, parent=parent, id_col=id_col).join(F.broadcast(best.select(parent, "rank")), parent)
        got = got.select(parent, F.lit(None).cast("string").alias(id_col), "score", "rank", F.lit(1).alias("place"), F.col("context").alias("text"), "n_children", "hit_ids")
    else:
        got = rows.select(parent, F.col(id_col).cast("string").alias(id_col), "score", "rank", "place", "text", F.lit(None).cast("long").alias("n_children"), F.array_join(ids, ",").alias("hit_ids"))
    bare = best.join(rows.select(parent).distinct(), parent, "left_anti").select(parent, "rank")
    own = lambda df: df.select(parent, F.col(id_col).cast("string").alias(id_col), "score", "rank", F.row_number().over(W.partitionBy("rank").orderBy(F.desc("score"), id_col)).alias("place"), "text", F.lit(None).cast("long").alias("n_children"), F.lit(None).cast("string").alias("hit_ids"))
    kept = own(hits.join(F.broadcast(bare), parent))
    known = F.coalesce(F.col(parent).cast("string"), F.lit("")) != ""
    none = own(hits.withColumn("rank", F.lit(1)).withColumn("_known", F.max(known).over(W.partitionBy())).where("not _known"))  # over k hits
    return got.unionByName(kept).unionByName(none)
