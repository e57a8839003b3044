"""Order-preserving fuzzy deduplication: each text joins the first earlier cluster whose head is similar enough."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..session import kept


def similar_pairs(texts: DataFrame, least: float = 0.88) -> DataFrame:
    """(earlier, later) of texts (pos, text) whose sequence similarity reaches ``least``.

    The ratio is at most 2 * shorter / (shorter + longer), so only texts of near
    lengths meet: lengths are cut into bands whose width grows with the length, and
    a text is looked up in its own band and the one above.
    """
    rows = texts.select("pos", norm_text(F.col("text")).alias("t")).withColumn("n", F.length("t"))
    bound = least / (2 - least)
    band = F.when(F.col("n") == 0, -1).otherwise(F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / bound)))).cast("int")
    rows = rows.withColumn("band", band)
    up = rows.select("pos", "t", "n", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    a, b = up.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.pos") != F.col("b.pos")) & (F.least("a.n", "b.n") >= bound * F.greatest("a.n", "b.n")))
    first = F.col("a.pos") < F.col("b.pos")
    pairs = pairs.select(
        F.least("a.pos", "b.pos").alias("earlier"), F.greatest("a.pos", "b.pos").alias("later"), F.when(first, F.col("a.t")).otherwise(F.col("b.t")).alias("x"), F.when(first, F.col("b.t")).otherwise(F.col("a.t")).alias("y")
    ).dropDuplicates(["earlier", "later"])

    @F.pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for later, earlier in parts:
            out = []
            for p, q in zip(later, earlier):
                m = difflib.SequenceMatcher(None, p, q)
                out.append(m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least)
            yield pd.Series(out, dtype=bool)

    return pairs.where(alike("y", "x")).select("earlier", "later")


def clusters(texts: DataFrame, least: float = 0.88, rounds: int | None = None) -> DataFrame:
    """pos, head for each text: the heads are the texts similar to no earlier head.

    Each round settles the texts without an undecided earlier neighbour; links stay
    distributed and are written between rounds, so lineage stays short.  The first
    undecided text is settled in any case, so the rounds end; more than ``rounds`` of
    them, if given, are an error.
    """
    links = kept(similar_pairs(texts, least), "alike")
    state = texts.select("pos", F.lit(None).cast("boolean").alias("is_head"))
    for k in itertools.count(1):
        seen = links.join(state.select(F.col("pos").alias("earlier"), "is_head"), "earlier").groupBy(F.col("later").alias("pos"))
        seen = seen.agg(F.max(F.coalesce("is_head", F.lit(False))).alias("near_head"), F.max(F.col("is_head").isNull()).alias("waits"))
        decided = F.when(F.col("near_head"), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        state = kept(state.join(seen, "pos", "left").select("pos", F.coalesce("is_head", decided).alias("is_head")), "heads")
        if state.where("is_head is null").isEmpty():
            break
        if k == rounds:
            raise RuntimeError(f"texts are undecided after {rounds} rounds")
    heads = links.join(state.where("is_head").select(F.col("pos").alias("earlier")), "earlier").groupBy(F.col("later").alias("pos")).agg(F.min("earlier").alias("first"))
    return state.join(heads, "pos", "left").select("pos", F.when(F.col("is_head"), F.col("pos")).otherwise(F.col("first")).alias("head"))


def merge(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each cluster of requirements (pos, requirement, must_cover, conditions, source): the head's text, all sources in order, lists joined and sorted where rows were merged."""
    got = rows.join(groups, "pos").groupBy("head").agg(
        F.min_by("requirement", "pos").alias("requirement"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("must_cover")))).alias("all_cover"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("conditions")))).alias("all_conditions"),
        F.min_by("must_cover", "pos").alias("own_cover"), F.min_by("conditions", "pos").alias("own_conditions"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("source_refs"),
    )
    one = lambda a, b: F.when(F.col("n") > 1, F.col(a)).otherwise(F.col(b))
    return got.select("head", "requirement", "n", one("all_cover", "own_cover").alias("must_cover"), one("all_conditions", "own_conditions").alias("conditions"), "source_refs")
