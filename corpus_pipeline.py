"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last return
the columns of documents.

For all stages: a null in any column but text is a value like others and is kept; an
empty table gives an empty one; a very long text is handled whole; columns may have any
names, also those that an operator uses itself.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language_id, mixing, near_dedup, packing, secret_scan
from corvane.llm.common import columns, free_name, materialised, words


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and letterless documents, and those without a language of two fifths of the votes; equal rows go or stay together.  Empty texts are letterless."""
    net = language_id.learn(docs)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    got = language_id.predicted(docs, net, lang, score)
    return got.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= 0.4)).select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, hold: int = 100_000) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least doc_id (null first, then the least md5); rows that repeat it go too.

    Null, empty and blank texts are no copies of anything and all stay.
    """
    classes, keepers = near_dedup.near_classes(docs.select("doc_id", "text"))
    own = keepers.select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key"), F.col("n").alias("k_n"))
    # rows of classes of two and more, and whether they are the ones that stay
    gone = classes.join(own, F.col("class_key") == F.col("k_key"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), (F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key"))).alias("_stays"), "k_n")
    gone = materialised(gone.where(~F.col("_stays") | (F.col("k_n") > 1)).distinct(), "copies")
    few = F.broadcast(gone) if gone.count() <= hold else gone
    # a document travels as one column, so its own names don't matter
    told = docs.select(F.struct(*columns(docs)).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.md5("text").alias("_k"))
    told = told.join(few, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    once = told.where(F.col("_id").isNull() & F.col("_key").isNull()).select("_doc.*")
    again = told.where("_stays").dropDuplicates(["_k"]).select("_doc.*")
    return once.unionByName(again)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay, null and empty texts as they are, and n_chars follows the text."""
    got = secret_scan.redact(docs, secret_scan.identifiers(docs))
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns(docs)) if "n_chars" in docs.columns else got


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.  Documents without words count nothing; of equal rows as many are taken as are needed."""
    size = F.size(words(F.col("text"))).cast("long")
    how = mixing.plan(docs, size, mixing.favoured(size))
    got = mixing.with_copies(docs, how, size, mixing.favoured(size)).where("copies > 0")
    return got.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; each row is a piece of a document with its ids.  Null and empty texts are the end id alone; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained network, signatures and a compressor decide here; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
