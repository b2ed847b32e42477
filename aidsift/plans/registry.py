"""Query registry: name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

import importlib
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, Optional[str]]] = {}

_MODULES = ["q_text", "q_rules", "q_merge", "q_link", "q_aggregate", "q_sample",
            "q_enrich", "q_scoring", "q_models", "q_io", "q_basics"]


def query(name: str, sql: Optional[str] = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, Optional[str]]]:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__package__}.{m}":
                raise
    return QUERIES
