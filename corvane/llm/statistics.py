"""Statistics of whole texts, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, columns, words

#: The statistics that the learners use, all ratios or sizes that mean the same for a text of any length.
FEATURES = (
    "n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio",
    "upper_ratio", "bang_ratio", "pipe_ratio", "digit_ratio", "words_per_line",
)


def _left(text: Column, but: str) -> Column:
    """How many characters of the class ``but`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{but}]+", "")).cast("long")


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``_at``: where windows of five words start that the text in ``_w`` has twice or more, in order.

    Windows are told apart by 64-bit hashes of their words' 64-bit hashes.  What
    a lambda looks up is a column of its own, used more than once, so that it is
    worked out once for a row and not for each element.
    """
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    h, none = F.col("_h"), F.array().cast("array<bigint>")
    g = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    df = df.withColumn("_g", F.when(F.size(h) < 6, none).otherwise(g))
    g = F.col("_g")
    pairs = F.transform(g, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(pairs)))
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: F.coalesce((F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), F.get(s, j - 1)["k"] == x["k"], F.get(s, j + 1)["k"] == x["k"]))
    return df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))


def _covered(at: Column) -> Column:
    """Words covered by windows of five that start there."""
    steps = F.transform(at, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - x, F.lit(5))))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """doc (all columns of ``df``, whatever their names), base (counts) and stats (FEATURES) of the text column of each row; null counts as empty."""
    df = df.select(F.struct(*columns(df)).alias("doc"), F.col(text).alias("_text"))
    t = F.coalesce(F.col("_text"), F.lit(""))
    df = df.withColumn("_w", words(F.col("_text")))
    df = _repeats(df)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    df = df.withColumn("_l", lines)
    df = df.withColumn(
        "base",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            _left(t, "#*$%&|<>").alias("n_symbols"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            _covered(F.col("_at")).alias("n_repeat_words"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
            _left(t, "\\p{Lu}").alias("n_upper"),
            _left(t, "!").alias("n_bang"),
            _left(t, "|").alias("n_pipe"),
            _left(t, "0-9").alias("n_digits"),
        ),
    )
    b = F.col("base")
    n, c = F.greatest(b["n_words"], F.lit(1)), F.greatest(b["word_chars"], F.lit(1))
    ratio = {
        "mean_word": b["word_chars"] / n, "symbol_ratio": b["n_symbols"] / c, "dup_line_ratio": b["n_dup_lines"] / F.greatest(b["n_lines"], F.lit(1)),
        "repeat_ratio": b["n_repeat_words"] / n, "distinct_ratio": b["n_distinct"] / n, "upper_ratio": b["n_upper"] / c, "bang_ratio": b["n_bang"] / c,
        "pipe_ratio": b["n_pipe"] / c, "digit_ratio": b["n_digits"] / c, "words_per_line": b["n_words"] / F.greatest(b["n_lines"], F.lit(1)), "n_words": b["n_words"].cast("double"),
    }
    return df.select("doc", "base", F.struct(*[ratio[k].alias(k) for k in FEATURES]).alias("stats"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, rows: Column | None = None) -> list[tuple]:
    """(label, FEATURES...) of a sample of labelled documents, ``bound`` at most.

    Documents are chosen by hashes of doc_id and of doc_id and text against the shares
    that the numbers of labels and of labelled rows allow, equal rows once, those of the
    least hashes if there are more, so reruns agree; documents whose labels differ
    are left out.
    """
    most = 1 << 30
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if rows is not None:
        one = one.where(rows)
    one = one.groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    share = min(1.0, bound / max(1, one.count()))
    some = one.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(most)) < int(share * most)).select(F.col("doc_id").alias("_id"), "_y")
    # the sample has a bound of its own, so every task can hold it; a doc_id may stand for many rows
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    share = min(1.0, 1.1 * bound / max(1, found.count()))
    found = found.withColumn("_h", F.xxhash64("doc_id", "text")).where(F.pmod("_h", F.lit(most)) < int(share * most))
    got = with_statistics(found).select("doc.doc_id", "doc._y", "stats", F.col("doc._h").alias("h")).distinct()
    got = got.orderBy("h", "doc_id", "stats").limit(bound).collect()
    return [(r["_y"], *r["stats"]) for r in sorted(got, key=lambda r: (r["doc_id"], tuple(r["stats"])))]
