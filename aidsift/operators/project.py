"""Projections and filters (PRJ1-PRJ8, FLT1, FLT3-FLT7)."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ1."""
    return df.select(*cols)


def keep_first(df: DataFrame, n: int, extra: Sequence = ()) -> DataFrame:
    """PRJ2: the first ``n`` original columns, then ``extra``."""
    return df.select(*df.columns[:n], *extra)


def cols_ending(df: DataFrame, suffix: str) -> list[str]:
    """PRJ3."""
    return [c for c in df.columns if c.endswith(suffix)]


def drop_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """PRJ4."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ5."""
    return df.withColumnsRenamed(dict(mapping))


def strip_name_spaces(df: DataFrame) -> DataFrame:
    """PRJ6: remove blanks from column names."""
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def common_cols(a: DataFrame, b: DataFrame) -> list[str]:
    """PRJ7: names both frames share, in ``a``'s order."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def with_const(df: DataFrame, name: str, value) -> DataFrame:
    """PRJ8: constant (or copied, when ``value`` is a Column) column."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def where_in(df: DataFrame, col: str, values: Sequence, negate: bool = False) -> DataFrame:
    """FLT1: membership filter (a NULL value never passes)."""
    cond = F.col(col).isin(list(values))
    return df.where(~cond if negate else cond)


def min_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """FLT3: not NULL and longer than ``n`` characters."""
    return df.where(F.col(col).isNotNull() & (F.length(col) > n))


def year_in(df: DataFrame, col: str, lo: int | None = None, hi: int | None = None,
            years: Sequence[int] | None = None, date_col: str | None = None) -> DataFrame:
    """FLT4: year range and/or set; on a partition column this prunes files.
    With ``date_col`` (the date the year comes from) the range is also
    stated on the raw date, a predicate Parquet can push down and use to
    skip row groups."""
    c = F.col(col)
    cond = F.lit(True)
    if date_col is not None and lo is not None:
        cond = cond & (F.col(date_col) >= F.make_timestamp_ntz(F.lit(lo), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    if date_col is not None and hi is not None:
        cond = cond & (F.col(date_col) < F.make_timestamp_ntz(F.lit(hi + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    if years is not None:
        cond = cond & c.isin(list(years))
    return df.where(cond)


def row_sum(cols: Sequence) -> Column:
    """AG22: NULL-ignoring row sum."""
    cs = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in cols]
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


def drop_zero(df: DataFrame, cols: Sequence[str] = ("usd_commitment", "usd_disbursement")) -> DataFrame:
    """FLT6: keep rows whose NULL-ignoring sum of ``cols`` is positive
    (the intended form: the frame's own columns)."""
    return df.where(row_sum(cols) > 0)


def strong_match(df: DataFrame, match_type: str = "iati_match_type",
                 source_text: str = "source_text", text: str = "iati_text",
                 min_len: int = 20, blank: bool = False) -> DataFrame:
    """FLT7: keep identifier matches, or text matches whose source text is
    longer than ``min_len``; with ``blank=True`` keep every row but blank
    the linked text of the weak ones."""
    mt = F.col(match_type)
    ok = (mt == "identifier") | ((F.coalesce(mt, F.lit("")) != "")
                                 & (F.length(F.col(source_text)) > min_len))
    ok = F.coalesce(ok, F.lit(False))
    if blank:
        return df.withColumn(text, F.when(ok, F.col(text)).otherwise(F.lit("")))
    return df.where(ok)
