"""What the training-data operators share: tables, words, scratch tables, Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

#: ASCII white space, and the words between it.
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it again: work is kept when executors go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that is not needed any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables that go together once what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table to the shared folder and reads it again, as materialised() does."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; nothing that is still to run may read them."""
        for path in self.paths:
            drop_scratch(self.spark, path)
        self.paths = []


def running(df: DataFrame, order: list[str], scratch: Scratch, value: str | None = None, high: str | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``value``, or the most of ``high``, over all rows before in ``order``; null at the first.

    Rows are dealt by ranges; each range is walked by itself after the ranges'
    own sums, a row each, so no task has all rows.
    """
    held = scratch.kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    whole = F.sum(value) if value else F.max(high)
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = held.groupBy("_part").agg(whole.alias("_w"))
    parts = parts.select("_part", (F.sum("_w") if value else F.max("_w")).over(upto).alias("_outer"))
    inner = whole.over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    got = held.withColumn("_inner", inner).join(F.broadcast(parts), "_part")  # a row for each range
    both = F.when(F.coalesce("_inner", "_outer").isNotNull(), F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0))) if value else F.greatest("_inner", "_outer")
    return got.withColumn("before", both).drop("_part", "_inner", "_outer")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of texts small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
