"""Extraction of requirements: article texts, model replies, coverage, resuming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans import prompts

#: Shape of a model's reply.
REPLY = (
    "requirements array<struct<id:string,topic:string,requirement:string,must_cover:array<string>,conditions:array<string>,"
    "deadline:string,responsible_party:string,severity:string,source_section:string,source_quote:string>>"
)


def articles(nodes: DataFrame) -> DataFrame:
    """The article nodes, with their place by header path (null as empty) and id."""
    return nodes.where("node_level = 'article'").withColumn("order", F.struct(F.coalesce("header_path", F.lit("")).alias("header_path"), F.col("node_id").alias("node_id")))


def assemble(articles: DataFrame, children: DataFrame, key: str = "node_id", parent: str = "parent") -> DataFrame:
    """Article text and its children's, by index (null last) and ``pos``: key, text, n_children.  Empty texts count as parts too, null ones as empty."""
    kids = children.groupBy(F.col(parent).alias(key)).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("idx", F.lit(1_000_000_000)).alias("idx"), "pos", F.coalesce("text", F.lit("")).alias("text")))).alias("kids")
    )
    got = articles.join(kids, key, "left")
    parts = F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce(F.transform("kids", lambda x: x["text"]), F.array().cast("array<string>")))
    return got.select(key, F.array_join(parts, "\n\n").alias("text"), F.when(F.col("kids").isNull(), 0).otherwise(F.size("kids")).alias("n_children"))


def json_part(reply: Column) -> Column:
    """The JSON object of a reply: fences removed, or from the first brace to the last."""
    bare = F.trim(F.regexp_replace(reply, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def requirements(replies: DataFrame, key: str = "article_id", reply: str = "reply", source_name: str | None = None, header: str | None = None) -> DataFrame:
    """One row for each requirement of a reply; ordinals count blank ones too, which are then left out.

    A given id stays, else it is made of article and ordinal; a section that is not
    given is the ``header`` column's.
    """
    head = F.col(header) if header else F.lit(None).cast("string")
    got = replies.select(key, head.alias("_head"), F.from_json(json_part(F.col(reply)), REPLY).alias("r"))
    got = got.select(key, "_head", F.posexplode("r.requirements").alias("n", "q")).where(strip(F.coalesce("q.requirement", F.lit(""))) != "")
    none = F.array().cast("array<string>")
    filled = lambda c: F.when(c != "", c)  # noqa: E731  an empty text counts as absent
    made = F.concat(F.col(key).cast("string"), F.lit("-REQ-"), F.lpad((F.col("n") + 1).cast("string"), 3, "0"))
    return got.select(
        key, F.coalesce(filled(F.col("q.id")), F.when(F.col("n") < 999, made).otherwise(F.concat(F.col(key).cast("string"), F.lit("-REQ-"), (F.col("n") + 1).cast("string")))).alias("id"),
        F.lit(source_name).cast("string").alias("source_name"), F.coalesce(filled(F.col("q.source_section")), F.col("_head")).alias("source_section"), strip(F.coalesce("q.topic", F.lit(""))).alias("topic"),
        strip(F.col("q.requirement")).alias("requirement"), F.coalesce("q.must_cover", none).alias("must_cover"), F.coalesce("q.conditions", none).alias("conditions"), F.col("q.deadline").alias("deadline"),
        F.col("q.responsible_party").alias("responsible_party"), F.coalesce("q.severity", F.lit("medium")).alias("severity"), F.coalesce("q.source_quote", F.lit("")).alias("source_quote"), (F.col("n") + 1).alias("ordinal"),
    )


def to_process(articles: DataFrame, cache: DataFrame, key: str = "article_id", force: bool = False) -> DataFrame:
    """Articles without a cached result, or all."""
    return articles if force else articles.join(cache.select(key), key, "left_anti")


def complete(texts: DataFrame, model: Callable[[str], str], prompt: str = "{text}", key: str = "article_id") -> DataFrame:
    """key, reply, error: the model's reply to each text; a failure is that row's error and stops nothing else.

    ``{name}`` in the prompt stands for the column of that name (null as empty); other braces are text.
    """
    used = [c for c in texts.columns if "{" + c + "}" in prompt and c != key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    replies.append(model(prompts.fill(prompt, **{k: "" if row[k] is None else str(row[k]) for k in (*used, key)})))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  told as a row
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: batch[key], "reply": replies, "error": errors})

    return texts.select(key, *used).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, reply string, error string")


def coverage(texts: DataFrame, found: DataFrame, key: str = "article_id", failed: DataFrame | None = None) -> DataFrame:
    """Children, characters and requirements of each article, and its status: success, or error with the message where ``failed`` (key, error) has it."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    got = texts.join(n, key, "left")
    got = got.withColumn("error", F.lit(None).cast("string")) if failed is None else got.join(failed.select(key, "error"), key, "left")
    status = F.when(F.col("error").isNull(), "success").otherwise("error")
    return got.select(key, "n_children", F.length("text").alias("text_length"), F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("requirements_extracted"), status.alias("status"), "error")


def now() -> Column:
    """The time in UTC as ISO text; leave it out of what is compared."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def payload(found: DataFrame, kept: DataFrame, n_articles: Column | int, n_done: Column | int, source_name: str) -> DataFrame:
    """One row: the counts of an extraction.  The requirements themselves are a table, ``kept``."""
    raw, left = found.agg(F.count("*").alias("requirements_raw_count")), kept.agg(F.count("*").alias("requirements_deduped_count"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  one row each
    got = one(raw).join(one(left), "_k").drop("_k")
    return got.select(F.lit(source_name).alias("source_name"), F.lit(n_articles).cast("long").alias("article_nodes_total"), F.lit(n_done).cast("long").alias("article_nodes_cached_or_processed"), "requirements_raw_count", "requirements_deduped_count")
