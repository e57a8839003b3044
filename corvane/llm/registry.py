"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage; each module has a function of the query's name.
QUERIES = {
    "op1_quality_rules": "quality_rules",
    "op2_secret_scan": "secret_scan",
    "op3_token_binary": "token_binary",
    "op4_mixing": "mixing",
    "op5_ann_graph": "ann_graph",
    "op6_language_id": "language_id",
    "op7_token_counts": "token_counts",
    "op8_near_dedup": "near_dedup",
    "op9_quality_trees": "quality_trees",
    "op10_packing": "packing",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def late(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return {name: late(module, name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": import_module(f"{__package__}.mixing").ORACLE_SQL}
