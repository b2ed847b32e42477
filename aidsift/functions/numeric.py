"""Confidence arithmetic (SC21-SC24): sigmoid, softmax, argmax, thresholds,
most-confident choice and hierarchical propagation."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c) -> Column:
    """SC21."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def softmax(arr) -> Column:
    """SC21: numerically stable softmax over an array column."""
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(arr) -> Column:
    """SC21: 0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def threshold(c, t: float = 0.5, inclusive: bool = False) -> Column:
    """SC22: ``> t`` (base models) or ``>= t`` (joint)."""
    return _c(c) >= t if inclusive else _c(c) > t


def most_confident(a, b) -> Column:
    """SC23: the confidence nearer to 0 or 1; tie -> the first."""
    a, b = _c(a), _c(b)
    return F.when(F.least(a, 1 - a) <= F.least(b, 1 - b), a).otherwise(b)


def propagate_conf(df: DataFrame, chain: Sequence[str], t: float = 0.5) -> DataFrame:
    """SC24 (joint form): walking child -> parent, a parent takes the child's
    confidence when the child's is not below ``t``."""
    for child, parent in zip(chain, chain[1:]):
        df = df.withColumn(parent, F.when(F.col(child) < t, F.col(parent)).otherwise(F.col(child)))
    return df


def propagate_flags(df: DataFrame, chain: Sequence[tuple[str, str]]) -> DataFrame:
    """SC24 (flag form): a predicted child sets the parent predicted and
    lifts its confidence to the child's when higher.
    ``chain`` = [(pred, conf), ...] from child to parent."""
    for (cp, cc), (pp, pc) in zip(chain, chain[1:]):
        lift = F.col(cp) & ~F.col(pp)
        df = df.withColumn(pc, F.when(lift, F.col(cc)).otherwise(F.col(pc)))
        df = df.withColumn(pp, F.col(pp) | F.col(cp))
    return df
