"""State between runs: versioned tables, small JSON files, caches and named stores, on any file system Spark reaches."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..session import kept


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _child(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


# -- versioned tables -----------------------------------------------------
def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, oldest first."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(_child(spark, f"{path}/{n}/_SUCCESS")))


def newest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest with a number under ``below``."""
    got = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.parquet(f"{path}/v={got[-1]}") if got else None


def save(df: DataFrame, path: str, number: int | None = None, keep: int = 2) -> DataFrame:
    """Writes ``df`` as a new version and reads it; older versions than the last ``keep`` go.  Readers see whole versions only."""
    spark = df.sparkSession
    got = versions(spark, path)
    number = (got[-1] + 1 if got else 0) if number is None else number
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    _, fs = _fs(spark, path)
    for v in [v for v in got if v < number][: -(keep - 1) or None]:
        fs.delete(_child(spark, f"{path}/v={v}"), True)
    return spark.read.schema(df.schema).parquet(f"{path}/v={number}")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds ``pos``, from 0 in the order of a column: counts by range partition, then places inside, so no task holds all rows."""
    held = kept(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return held.withColumn("_in", inside).join(F.broadcast(counts), "_part").withColumn("pos", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_n", "_before")


# -- small JSON files -----------------------------------------------------
def load_json(spark: SparkSession, path: str, default=None):
    """The value of a JSON file, or ``default`` where there is none."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return default
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_json(spark: SparkSession, path: str, value) -> None:
    """Writes a JSON file beside its place and moves it there; folders are made."""
    at, fs = _fs(spark, path)
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    other = _child(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(other, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(other, at):
        raise OSError(f"{path} can't be written")


def load_rules(spark: SparkSession, path: str | None = None, family: str | None = None, folder: str | None = None) -> list[dict]:
    """Heading rules of a file: the given one, else the family's in ``folder``; none where it is absent or can't be read as rules."""
    place = path or (f"{folder}/{family}.json" if family and folder else None)
    try:
        got = load_json(spark, place, {}) if place else {}
        return [{"pattern": r["pattern"], "level": int(r["level"]), "strip_match": bool(r.get("strip_match", False))} for r in got.get("heading_rules", [])]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


#: Fields of a parse family; hierarchy is a list of levels (level, name, pattern_type, pattern, example, contains_content).
FAMILY = ("family_id", "family_description", "hierarchy", "special_sections", "noise_patterns", "sample_passages", "validated", "created_from")


def save_family(spark: SparkSession, folder: str, family: dict) -> None:
    save_json(spark, f"{folder}/{family['family_id']}.json", {k: family.get(k, {"validated": False, "created_from": ""}.get(k, [])) for k in FAMILY})


def load_family(spark: SparkSession, folder: str, family_id: str) -> dict | None:
    """A family as it was saved, levels and all, or None."""
    return load_json(spark, f"{folder}/{family_id}.json")


def list_families(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))


# -- file cache -----------------------------------------------------------
def add_to_cache(spark: SparkSession, folder: str, documents: DataFrame, file: tuple[str, ...] = ("path",)) -> DataFrame:
    """Adds loaded documents (path, checksum, ...) to the cache table; those of a file and checksum that it has are left out.

    ``file`` are the columns that tell files apart, more than the path where several
    files can have one.  An entry keeps ``entry``, the version that brought it; one
    earlier version of the whole cache stays.
    """
    old = newest(spark, folder)
    if old is None:
        fresh = documents
    else:
        known = old.select(*[F.col(c).alias(f"_{c}") for c in (*file, "checksum")]).distinct()
        fresh = documents.join(known, reduce(and_, [F.col(c[1:]).eqNullSafe(F.col(c)) for c in known.columns]), "left_anti")
    fresh = fresh.withColumn("entry", F.lit((versions(spark, folder) or [-1])[-1] + 1))
    return save(fresh if old is None else old.unionByName(fresh), folder)


def cache_index(cache: DataFrame, file: tuple[str, ...] = ("path",)) -> DataFrame:
    """The columns of ``file``, checksum, n_documents: the latest entry of each file, and how many documents the cache has of it, those of earlier entries too."""
    return cache.groupBy(*file).agg(F.max_by("checksum", "entry").alias("checksum"), F.count("*").cast("int").alias("n_documents"))


def one_path(documents: DataFrame) -> str | None:
    """The only path of documents that came from one file; more than one is an error."""
    got = [r["path"] for r in documents.select("path").distinct().limit(2).collect()]
    if len(got) > 1:
        raise ValueError("documents of more than one file")
    return got[0] if got else None


# -- named stores ---------------------------------------------------------
class Store:
    """A keyed table (id, ...) by name below a folder: documents, vectors or cached values, upserted as versions."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{name}"

    def read(self) -> DataFrame | None:
        return newest(self.spark, self.path)

    def put(self, rows: DataFrame, key: str = "node_id") -> DataFrame:
        """Rows replace those of the same key; equal keys in ``rows`` are the caller's error."""
        old = self.read()
        return save(rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True), self.path)

    def delete(self, keys: DataFrame, key: str = "node_id") -> DataFrame | None:
        old = self.read()
        return None if old is None else save(old.join(keys.select(key), key, "left_anti"), self.path)

    def add_vectors(self, rows: DataFrame, key: str = "node_id") -> DataFrame:
        """put() of the rows that have an embedding."""
        return self.put(rows.where("embedding is not null"), key)


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the stores below a folder."""
    at, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def drop_tables(spark: SparkSession, folder: str, names: list[str] | None) -> None:
    """Deletes the named stores, where they exist; no names is an error."""
    if not names:
        raise ValueError("name the tables to drop")
    for name in names:
        at, fs = _fs(spark, f"{folder}/{name}")
        fs.delete(at, True)


# -- cached transforms ----------------------------------------------------
def transform_key(step: Callable) -> str:
    """What tells a step apart: its name and its source, or what it says of itself."""
    if hasattr(step, "class_name"):
        return str(step.class_name())
    try:
        return f"{step.__module__}.{step.__qualname__}:{hash_text(inspect.getsource(step))}"
    except (OSError, TypeError, AttributeError):
        return repr(step)


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def input_hash(df: DataFrame, *columns: str) -> str:
    """A hash of all rows, whatever their order."""
    one = F.conv(F.substring(content_hash(*[F.col(c) for c in columns or df.columns]), 1, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.sum(one).alias("s"), F.count("*").alias("n")).first()
    return hash_text(f"{got['s']}|{got['n']}")


def cached_step(df: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The step's result, from the folder if the same rows went through the same step before."""
    spark = df.sparkSession
    place = f"{folder}/{hash_text(input_hash(df, *columns) + transform_key(step))}"
    found = newest(spark, place)
    return found if found is not None else save(step(df), place)
