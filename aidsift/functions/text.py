"""Text and key normalisation (SC1-SC17).

All functions return Spark ``Column`` expressions (no Python UDFs), so they
stay inside whole-stage codegen and run on whole texts.

Punctuation classes differ between the reference's two languages, so
``remove_punct`` takes a ``punct`` mode:

* ``"word"``    - Python ``[^\\w\\s]`` on Unicode text (letters, digits, ``_`` kept)
* ``"unicode"`` - R/ICU ``[[:punct:]]`` = Unicode punctuation ``\\p{P}``
* ``"ascii"``   - everything but ``[a-z0-9]`` (on lower-cased text) is a
  separator; the form whose results agree across engines.
"""

from __future__ import annotations

import re
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = {
    "word": r"(?U)[^\w\s]",
    "unicode": r"\p{P}",
    "ascii": r"[^a-z0-9\s]",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Spark ``trim`` strips
    blanks only, not tabs, newlines or no-break spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def lower_trim(c) -> Column:
    """SC1: lower-case and trim."""
    return trim_ws(F.lower(_c(c)))


def remove_punct(c, punct: str = "word") -> Column:
    """SC2: punctuation -> one space."""
    if punct == "ascii":
        return F.regexp_replace(_c(c), r"[^a-z0-9]", " ")
    return F.regexp_replace(_c(c), _PUNCT[punct], " ")


def collapse_ws(c) -> Column:
    """SC3: runs of whitespace -> one space."""
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def quote_regex(s: str) -> str:
    """SC4: escape regex metacharacters (driver-side, used while building a
    pattern). Letters, digits and ``_`` pass through unchanged."""
    return re.sub(r"([^\w\s])", r"\\\1", s)


def to_ascii(c) -> Column:
    """SC5: drop non-ASCII characters."""
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")


def strip_lead_zero(c) -> Column:
    """SC6: drop leading zeros from numeric strings, keep others unchanged.

    Pure digit strings keep all their digits (no 15-digit float rounding);
    ``007.50`` becomes ``7.5``; exponents and mixed ids stay as they are.
    """
    c = _c(c)
    ints = F.regexp_replace(c, r"^0+", "")
    int_form = F.when(ints == "", F.lit("0")).otherwise(ints)
    # decimal: strip leading zeros of the integer part, trailing of the fraction
    ip = F.regexp_extract(c, r"^0*([0-9]*)\.([0-9]*?)0*$", 1)
    fp = F.regexp_extract(c, r"^0*([0-9]*)\.([0-9]*?)0*$", 2)
    ip = F.when(ip == "", F.lit("0")).otherwise(ip)
    dec_form = F.when(fp == "", ip).otherwise(F.concat(ip, F.lit("."), fp))
    return (F.when(c.rlike(r"^[0-9]+$"), int_form)
             .when(c.rlike(r"^[0-9]*\.[0-9]+$"), dec_form)
             .otherwise(c))


def norm_key(c, punct: str = "unicode") -> Column:
    """SC7: project-number key normaliser, R order:
    trim -> strip_lead_zero -> to_ascii -> lower -> remove_punct -> trim -> collapse."""
    x = strip_lead_zero(trim_ws(_c(c)))
    x = remove_punct(F.lower(to_ascii(x)), punct)
    return collapse_ws(trim_ws(x))


def norm_text(c, punct: str = "word", trim_last: bool = True) -> Column:
    """SC8: text normaliser: lower, trim, punctuation -> space, collapse.

    ``trim_last`` trims again after collapsing (the enrichment form), so no
    leading/trailing blank is left. ``punct="ascii"`` also turns every
    non-ASCII character into a separator.
    """
    if punct == "ascii":
        # every non [a-z0-9] run is a separator, so trimming first is moot
        return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " "))
    x = collapse_ws(remove_punct(lower_trim(c), punct))
    return F.trim(x) if trim_last else x


def join_text(cols: Sequence, sep: str = " ") -> Column:
    """SC9: concatenate with a separator, skipping NULLs (``""`` is kept)."""
    return F.concat_ws(sep, *[_c(c) for c in cols])


def word_pattern(words: Iterable[str], quote: bool = True) -> str:
    """SC10: whole-word alternation ``\\b(w1|w2|...)\\b``."""
    ws = [quote_regex(w) if quote else w for w in words]
    return r"\b(" + "|".join(ws) + r")\b"


def padded_pattern(words: Iterable[str]) -> str:
    """Alternation over already-normalised words, bounded by spaces.

    Used on ``pad(norm_text)``: a word matches only as whole tokens, with
    the same answer in every engine (``\\b`` differs for accented text).
    """
    ws = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    return " (" + "|".join(quote_regex(w) for w in ws) + ") "


def pad(c) -> Column:
    """Surround with single spaces so token matches need no ``\\b``."""
    return F.concat(F.lit(" "), _c(c), F.lit(" "))


def matches(c, pattern: str, ignore_case: bool = True) -> Column:
    """SC11: regex search (case-insensitive by default)."""
    return _c(c).rlike(("(?i)" if ignore_case else "") + pattern)


def contains_ci(c, s) -> Column:
    """SC12: case-insensitive containment."""
    s = F.lit(s) if isinstance(s, str) else s
    return F.contains(F.lower(_c(c)), F.lower(s))


def split_nonblank(c, sep: str = "\n") -> Column:
    """SC13: split on a literal separator and drop blank pieces."""
    parts = F.split(_c(c), re.escape(sep))
    return F.filter(parts, lambda x: F.length(trim_ws(x)) > 0)


def year_prefix(c) -> Column:
    """SC14: integer from the first four characters, NULL if unparsable."""
    return _c(c).substr(1, 4).try_cast("int")


def replace_literal(c, a: str, b: str) -> Column:
    """SC16: literal (non-regex) replace."""
    return F.replace(_c(c), F.lit(a), F.lit(b))


def prefix(c, n: int) -> Column:
    """SC17: first n characters."""
    return F.substring(_c(c), 1, n)
