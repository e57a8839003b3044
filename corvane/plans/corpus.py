"""Extraction over a whole corpus: articles, what is cached, replies, requirements, coverage, merged requirements, counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, extract
from ..sources import state
from . import prompts


@dataclass
class Extracted:
    """All tables of one run, and its one row of counts."""

    requirements: DataFrame
    merged: DataFrame
    coverage: DataFrame
    payload: DataFrame


def extract_corpus(nodes: DataFrame, model: Callable[[str], str], folder: str, source_name: str = "GDPR", cache_name: str = "legal_requirements", force: bool = False, deduplicate: Callable[[DataFrame], DataFrame] | None = None) -> Extracted:
    """Requirements of all articles of ``nodes`` (node_id, text, node_level, header_path, parent_article, article_child_index, pos).

    Articles that an earlier run under ``folder`` finished are not asked again unless
    ``force``.  An article whose reply fails or holds no JSON becomes an error row and is
    tried again by the next run.  What this run adds is written as a version of its
    own, so a lost executor repeats only its articles, and an earlier version stays.
    """
    spark = nodes.sparkSession
    place = f"{folder}/{cache_name}"
    arts = extract.articles(nodes).withColumnRenamed("node_id", "article_id")
    stored = state.newest(spark, place)
    todo = arts if stored is None or force else extract.to_process(arts, stored.where("status = 'success'"))
    kids = nodes.where("node_level = 'paragraph'").select(F.col("parent_article").alias("parent"), F.col("article_child_index").alias("idx"), "pos", "text")
    texts = extract.assemble(todo, kids, key="article_id").join(todo.select("article_id", "header_path"), "article_id")
    asked = texts.select("article_id", "header_path", F.col("text").alias("article_text"), "n_children", F.length("text").alias("text_length"))
    told = extract.complete(asked, model, prompts.REQUIREMENTS, "article_id")
    told = told.withColumn("error", F.when(F.col("error").isNull() & extract.json_part(F.col("reply")).isNull(), "no JSON object in the reply").otherwise(F.col("error")))
    rows = told.join(asked.drop("article_text"), "article_id").withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error")).withColumn("processed_at", extract.now())
    earlier = None if stored is None or force else stored.join(rows.select("article_id"), "article_id", "left_anti")
    cache = state.save(rows if earlier is None else rows.unionByName(earlier), place)

    found = extract.requirements(cache.where("status = 'success'"), source_name=source_name, header="header_path").withColumnRenamed("article_id", "source_article_id")
    order = F.struct(F.coalesce("source_section", F.lit("")), "source_article_id", "ordinal")
    found = state.save(found.withColumn("order", order), f"{place}_requirements")
    merged = (deduplicate or merge_alike)(found)
    n = found.groupBy("source_article_id").agg(F.count("*").alias("n"))
    log = cache.join(n, F.col("article_id") == F.col("source_article_id"), "left")
    log = log.select("article_id", "header_path", F.lit(source_name).alias("source_name"), F.col("n_children").alias("child_count"), "text_length", F.coalesce("n", F.lit(0)).alias("requirements_extracted"), "status", "error", "processed_at")
    done = cache.where("status = 'success'").count()
    return Extracted(found, merged, log, extract.payload(found, merged, arts.count(), done, source_name))


def merge_alike(found: DataFrame) -> DataFrame:
    """The default deduplication: requirements of like text become one, in the order of articles."""
    numbered = state.numbered(found, "order").withColumn("source", F.struct("source_article_id", "source_section", "id"))
    groups = dedup.clusters(numbered.select("pos", F.col("requirement").alias("text")))
    return dedup.merge(numbered, groups)


def payload_json(run: Extracted) -> str:
    """The counts as JSON; a row, so it is made on the driver."""
    return json.dumps(run.payload.first().asDict(), ensure_ascii=False, indent=2)


def save_payload(spark: SparkSession, run: Extracted, path: str) -> None:
    """Writes the counts so that a reader sees the old file or the new one."""
    state.save_json(spark, path, json.loads(payload_json(run)))
