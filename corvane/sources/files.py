"""Files as tables: scanning, pruning, reading, and CSV in and out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_date, glob_regex, uuid_from
from .readers import Reader, read

#: Suffixes and their types.
MIME = {".md": "text/markdown", ".mmd": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf", ".docx": "application/docx", ".pptx": "application/pptx", ".xlsx": "application/xlsx", ".epub": "application/epub+zip", ".ipynb": "application/x-ipynb+json", ".mbox": "application/mbox"}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"(?<=.)(\.[^.]+)$", 1)


def start_dir(path: Column, root: str) -> Column:
    """The first folder below the root; a file in the root gives its name."""
    return F.element_at(F.split(F.regexp_replace(path, f"^{re.escape(root.rstrip('/'))}/?", ""), "/"), 1)


def metadata(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Adds name, suffix, mime and main_dir; and the date of ``modificationTime`` if there is one."""
    lower = F.lower(suffix_of(F.col(path)))
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), lower)
    out = files.withColumns({"name": name_of(F.col(path)), "suffix": suffix_of(F.col(path)), "mime": mime, "main_dir": start_dir(F.col(path), root)})
    return out.withColumn("modified", file_date(F.col("modificationTime"))) if "modificationTime" in files.columns else out


def prune(files: DataFrame, path: str = "path", exclude: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = (), exclude_hidden: bool = True, required: tuple[str, ...] = (), tree_root: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Files that pass all filters, by path, ``limit`` at most.

    Excluded folders are plain prefixes.  A tree root pattern drops files of its
    suffix whose name doesn't match it.
    """
    p = F.col(path)
    for g in exclude:
        files = files.where(~p.rlike(glob_regex(g)))
    for d in exclude_dirs:
        files = files.where(~p.startswith(d))
    if exclude_hidden:
        files = files.where(~p.rlike(r"(^|/)\."))
    if required:
        files = files.where(suffix_of(p).isin(*required))
    for g in tree_root:
        ext = "." + g.rsplit(".", 1)[-1]
        files = files.where((suffix_of(p) != ext) | name_of(p).rlike(glob_regex(g)))
    files = files.orderBy(path)
    return files if limit is None else files.limit(limit)


def scan(spark: SparkSession, folder: str, recursive: bool = True, **filters) -> DataFrame:
    """path, length, modificationTime, content and metadata of the files of a folder; contents are read only where used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return metadata(prune(files, **filters), root=folder)


DOCUMENT = "path string, part int, id string, text string, metadata map<string,string>, error string"


def load(files: DataFrame, extractors: dict[str, Reader] | None = None, encoding: str = "utf-8", errors: str = "ignore", filename_as_id: bool = False, file_metadata: Callable[[str], dict] | None = None, raise_on_error: bool = False, with_errors: bool = False) -> DataFrame:
    """Documents of scanned files: path, part, id, text, metadata, error; blank texts are left out.

    ``extractors`` (suffix -> function of path and bytes) come before the built-in
    readers; unknown suffixes are plain text; kinds without a reader fail.  A file that
    can't be read raises, or is left out, or with ``with_errors`` becomes a row that
    says why; a missing module always raises.  ``file_metadata`` adds to each document's metadata, null values aside.
    """
    known = [c for c in ("name", "suffix", "mime", "main_dir", "modified", "length") if c in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                path = r["path"]
                try:
                    own = {k: str(r[k]) for k in known if r[k] is not None} | {"file_path": path}
                    own |= {k: str(v) for k, v in (file_metadata(path) if file_metadata else {}).items() if v is not None}
                    for k, (text, more) in enumerate(read(path, bytes(r["content"]), extractors, encoding, errors)):
                        if text.strip():
                            rows.append((path, k, f"{path}_part_{k}" if filename_as_id else None, text, own | more, None))
                except ImportError:
                    raise
                except Exception as e:
                    if raise_on_error:
                        raise
                    if with_errors:
                        rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "id", "text", "metadata", "error"]).astype({"part": "Int32"})

    got = files.select("path", "content", *known).mapInPandas(run, DOCUMENT)
    return got if filename_as_id else got.withColumn("id", F.coalesce("id", F.when(F.col("error").isNull(), uuid_from(F.concat_ws("|", "path", F.col("part").cast("string"))))))


def load_new(files: DataFrame, cache: DataFrame | None, **options) -> DataFrame:
    """Documents of all files: those whose path and checksum the cache (path, checksum, DOCUMENT) has come from there."""
    summed = files.withColumn("checksum", F.sha2("content", 256))
    if cache is None:
        return load(files, **options).join(summed.select("path", "checksum"), "path")
    fresh = summed.join(cache.select("path", "checksum").distinct(), ["path", "checksum"], "left_anti")
    return load(fresh, **options).join(fresh.select("path", "checksum"), "path").unionByName(cache, allowMissingColumns=True)


def suffixes(files: DataFrame) -> DataFrame:
    """The distinct suffixes."""
    return files.select(suffix_of(F.col("path")).alias("suffix")).distinct()


def without_sheets(documents: DataFrame, path: str = "path") -> DataFrame:
    """Documents that don't come from spreadsheets."""
    return documents.where(~F.col(path).endswith(".xlsx"))


def node_of(documents: DataFrame) -> DataFrame:
    """Documents (id, text, metadata, excluded_embed) as nodes: the model's excluded keys are the embedder's."""
    return documents.select(F.col("id").alias("node_id"), "text", "metadata", "excluded_embed", F.col("excluded_embed").alias("excluded_llm"))


def document_of(nodes: DataFrame) -> DataFrame:
    """Nodes as documents again, metadata values as text."""
    return nodes.select(F.col("node_id").alias("id"), "text", F.col("metadata").cast("map<string,string>").alias("metadata"), "excluded_embed", "excluded_llm")


def backup_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def restore_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
