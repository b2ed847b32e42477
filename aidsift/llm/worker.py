"""What a Python worker is sent, and keeps from task to task."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_held: dict[tuple, Any] = {}


def kept(make: Callable, *key: Hashable) -> Any:
    """``make(*key)``, made once and kept until this worker is to keep something else. Workers outlive the
    stages of a pipeline, so that what all stages keep would add up."""
    if (make, key) not in _held:
        release()
        _held[make, key] = make(*key)
    return _held[make, key]


def release() -> None:
    """Drop what an earlier stage has left in this worker."""
    if _held:
        _held.clear()
        gc.collect()  # an encoder's words refer back to it


def text_place(docs: DataFrame, text_col: str) -> tuple[int, list[Column]]:
    """Where rows of ``docs``, sent whole, hold the text as a string, and the columns to send besides:
    none if it is a string as it is, so that a worker gets each text once."""
    if docs.columns.count(text_col) == 1 and docs.schema[text_col].dataType.simpleString() == "string":
        return docs.columns.index(text_col), []
    return len(docs.columns), [F.col(text_col).cast("string").alias("_text")]
