"""Label-list functions (PRJ12-PRJ14, FLT5, SC19-SC20).

A label set travels as a comma string at the edges (``"PAF,Direct,AA"``)
and as ``array<string>`` inside; all functions are Column expressions.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c, mapping: Mapping, default=None) -> Column:
    """PRJ12: value recode through a literal map; unmapped -> ``default``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, _c(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def binarise(c, positives: Sequence[str], substring: bool = True) -> Column:
    """PRJ13: collapse a label (list) to 1/0: 1 if any positive label occurs
    (substring test as in the reference, or exact membership)."""
    c = _c(c)
    if substring:
        cond = F.lit(False)
        for p in positives:
            cond = cond | F.coalesce(c.contains(p), F.lit(False))
    else:
        cond = F.coalesce(c.isin(list(positives)), F.lit(False))
    return cond.cast("int")


def label_array(c, sep: str = ",") -> Column:
    """comma string -> array<string> (trimmed, blanks dropped)."""
    return F.filter(F.transform(F.split(_c(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def drop_parent(c, parent: str, sep: str = ",") -> Column:
    """PRJ14: remove ``parent`` from a label list when a finer label exists."""
    a = label_array(c, sep)
    return F.array_join(F.when(F.size(a) > 1, F.array_remove(a, parent)).otherwise(a), sep)


def has_label(c, yes: Sequence[str] | str, no: Sequence[str] | str = (), substring: bool = True) -> Column:
    """FLT5: contains every ``yes`` label and none of the ``no`` labels."""
    yes = [yes] if isinstance(yes, str) else list(yes)
    no = [no] if isinstance(no, str) else list(no)
    c = _c(c)
    if substring:
        test = lambda x: c.contains(x)
    else:
        arr = label_array(c)
        test = lambda x: F.array_contains(arr, x)
    cond = F.lit(True)
    for y in yes:
        cond = cond & test(y)
    for n in no:
        cond = cond & ~test(n)
    return F.coalesce(cond, F.lit(False))


def multi_hot(arr, labels: Sequence[str], strict: bool = False) -> Column:
    """SC19: array<string> -> array<double> with one slot per label.
    ``strict`` raises on a label outside the vocabulary (meta form);
    otherwise unknown labels are ignored (weighted form)."""
    arr = _c(arr)
    vocab = F.array(*[F.lit(x) for x in labels])
    hot = F.transform(vocab, lambda l: F.array_contains(arr, l).cast("double"))
    if strict:
        unknown = F.size(F.array_except(arr, vocab)) > 0
        return F.when(unknown, F.raise_error(F.lit("label outside the vocabulary"))).otherwise(hot)
    return hot


def label_id(c, labels: Sequence[str]) -> Column:
    """SC20: label -> 0-based id in ``labels`` (NULL if unknown)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), _c(c))
    return F.when(pos > 0, pos - 1).cast("int")
