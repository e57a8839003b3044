"""Incremental ingest as a stream: new files or rows arrive in micro-batches, each an upsert into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..sources import state


def stored(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    """The newest version of a keyed table below ``path``, or of those before number ``below``; else an empty one."""
    found = state.newest(spark, path, below)
    return spark.createDataFrame([], schema) if found is None else found


def upsert_stream(rows: DataFrame, table: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Runs store.upsert_diff for each micro-batch of ``rows`` (ref, hash, pos, ...).

    Every batch writes a version named after it from the versions before it, so a
    batch that runs again after a failure writes the same one.  The last ``keep`` stay.
    """

    def batch(df: DataFrame, number: int) -> None:
        old = stored(df.sparkSession, table, df.schema, number)
        changes = store.upsert_diff(df, old.select("ref", "hash"))
        state.save(store.apply_upsert(old, changes), table, number, keep)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
