"""Code-list flags, keyword matching and the Yes/Review/No rule engine
(SC30, JN18, RL1-RL4, PRJ9-PRJ11, FLT2).

Every step is a column expression over the row itself: no shuffle, no
Python worker, so the whole rule engine is one narrow, codegen'd stage and
also works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text, pad, padded_pattern

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results
# (OECD purpose / channel code lists, the CERF name and the ten "bad relief"
# organisation names), stated as plain data in their original order.
# ---------------------------------------------------------------------------
HUMANITARIAN_PURPOSE_CODES = [720, 72010, 72040, 72050, 730, 73010, 74020]
IDENTIFIED_CHANNEL_CODES = [
    21016, 21018, 21029, 23501, 41121, 41127, 41130, 41147, 41315, 41321,
    41403, 43003, 43005, 43006, 47123, 47137, 47502,
]
IDENTIFIED_PURPOSE_CODES = [12264, 15220, 15240, 15250, 15261, 43060]
ELIGIBLE_PURPOSE_CODES = [
    111, 11110, 11120, 11130, 11182, 112, 11220, 11230, 11231, 11232,
    11240, 11250, 11260, 121, 12110, 12191, 122, 12220, 12230, 12240,
    12250, 12261, 12262, 12263, 12281, 130, 13010, 13020, 13030, 13081,
    140, 14010, 14015, 14020, 14021, 14022, 14030, 14031, 14032, 14040,
    14050, 14081, 151, 15110, 15111, 15114, 15142, 15160, 15170, 15190,
    152, 160, 16010, 16020, 16050, 16062, 210, 21010, 21020, 21030, 21040,
    21050, 21061, 21081, 240, 24010, 24020, 24030, 24040, 24050, 24081,
    311, 31110, 31120, 31130, 31140, 31191, 321, 32130, 410, 41010, 430,
    43010, 43030, 43040, 43071, 43072, 43082, 510, 51010, 520, 52010, 600,
    60010, 60020, 60030, 60040, 60061, 60062, 60063,
]
CERF_NAME = "Central Emergency Response Fund"
BAD_RELIEF_PHRASES = [
    "Comic Relief", "Sport Relief", "Medical Relief Society",
    "Assemblies of God Relief and Development Services",
    "Catholic Relief Services", "AIDS Relief", "World Bicycle Relief",
    "KSrelief", "The RELIEF Centre", "Relief International",
]
# keyword category -> the label families it feeds (CF: CF only; PAF: PAF and
# AA keywords; AA: AA keywords only)
LABEL_FAMILIES = {
    "Crisis finance": ("CF",),
    "PAF": ("PAF", "AA"),
    "AA": ("AA",),
}
# ---------------------------------------------------------------------------

YES, REVIEW, NO = "Yes", "Review", "No"
_RANK = {NO: 0, REVIEW: 1, YES: 2}


def code_flag(c, codes: Iterable) -> Column:
    """SC30: membership in a code list; NULL code -> false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin(list(codes)), F.lit(False))


def add_code_flags(df: DataFrame, purpose: str = "purpose_code",
                   channel: str = "channel_code",
                   prefix: str = "Crisis finance") -> DataFrame:
    """SC30 over the three reference code lists: humanitarian, identified
    (channel or purpose list) and eligible."""
    return df.withColumns({
        "humanitarian": code_flag(purpose, HUMANITARIAN_PURPOSE_CODES),
        f"{prefix} identified": code_flag(channel, IDENTIFIED_CHANNEL_CODES)
        | code_flag(purpose, IDENTIFIED_PURPOSE_CODES),
        f"{prefix} eligible": code_flag(purpose, ELIGIBLE_PURPOSE_CODES),
    })


def drop_double_count(df: DataFrame, channel: str, donor: str,
                      name: str = CERF_NAME, variant: str = "py") -> DataFrame:
    """FLT2: drop rows routed *through* ``name`` as a channel while another
    donor reports them. ``variant='py'`` keeps rows whose channel is NULL;
    ``'r'`` follows R ``subset``, where a NULL condition drops the row."""
    ch, dn = F.col(channel), F.col(donor)
    if variant == "r":
        return df.where((ch != name) | (dn == name))
    return df.where(~(ch.eqNullSafe(name) & ~dn.eqNullSafe(name)))


def reset_blank(df: DataFrame, text_cols: Sequence[str],
                pred_cols: Sequence[str], conf_cols: Sequence[str],
                blanks: Sequence[str] = ("", "-"), null_is_blank: bool = True) -> DataFrame:
    """PRJ10: when every text column is blank, zero the confidences and
    clear the predictions. ``null_is_blank`` is the R form (NULL = "")."""
    def is_blank(c):
        c = F.col(c)
        return F.coalesce(c, F.lit("")).isin(list(blanks)) if null_is_blank \
            else F.coalesce(c.isin(list(blanks)), F.lit(False))
    cond = is_blank(text_cols[0])
    for c in text_cols[1:]:
        cond = cond & is_blank(c)
    upd = {c: F.when(cond, F.lit(False)).otherwise(F.col(c)) for c in pred_cols}
    upd.update({c: F.when(cond, F.lit(0.0)).otherwise(F.col(c)) for c in conf_cols})
    return df.withColumns(upd)


def update_where(df: DataFrame, col: str, cond: Column, value) -> DataFrame:
    """PRJ9: ``x[cond] = value``; a NULL condition leaves the value alone."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(F.coalesce(cond, F.lit(False)), v).otherwise(F.col(col)))


def bool_blank(df: DataFrame, cols: Sequence[str], true_text: str = "TRUE") -> DataFrame:
    """PRJ11: render booleans for export, false (and NULL) as ``""``."""
    return df.withColumns({c: F.when(F.col(c), F.lit(true_text)).otherwise(F.lit(""))
                           for c in cols})


# --- keyword matching (JN18) ----------------------------------------------

def normalise_keywords(keywords: Iterable[tuple[str, str]], punct: str = "word",
                       drop: Iterable[str] = ()) -> list[tuple[str, str]]:
    """Normalise (keyword, category) pairs on the driver with the same rules
    as the text (lower, trim, punctuation -> space, collapse)."""
    import re
    drop = set(drop)
    out = []
    for kw, cat in keywords:
        k = kw.lower().strip()
        if punct == "ascii":
            k = re.sub(r"[^a-z0-9]+", " ", k)
        elif punct == "unicode":
            k = re.sub(r"[^\w\s]|_", " ", k)
        else:
            k = re.sub(r"[^\w\s]", " ", k)
        k = re.sub(r"\s+", " ", k).strip()
        if k and k not in drop:
            out.append((k, cat))
    return out


def _families(keywords, families):
    return {name: sorted({k for k, c in keywords if c in cats})
            for name, cats in families.items()}


def words_only(text: Column, punct: str) -> Column:
    """Normalised text with its leftover symbols as separators, as word boundaries see them."""
    return F.trim(F.regexp_replace(text, r"[\p{S}\s]+", " ")) if punct == "unicode" else text


def keyword_match(df: DataFrame, text: str, keywords: Sequence[tuple[str, str]],
                  families: Mapping[str, Sequence[str]] = LABEL_FAMILIES,
                  method: str = "rlike", suffix: str = " keyword match", punct: str = "word") -> DataFrame:
    """JN18: one boolean per label family: does the normalised ``text``
    contain any keyword of the family as whole tokens?

    ``text`` must already be normalised (single spaces, no edge blanks) and
    ``keywords`` normalised the same way (``normalise_keywords``). The R form
    (``punct="unicode"``) leaves symbols in the text; they separate words here.

    * ``rlike``: one space-padded alternation per family; a narrow scan.
    * ``ngram``: all 1..n-token grams of the text tested against the keyword
      set with ``arrays_overlap``; same answer, for up to some thousands of
      keywords, as their set is built anew for each row. Larger keyword
      tables join: ``keywords.keyword_flags``.
    """
    fam = _families(keywords, families)
    out = {}
    words = words_only(F.col(text), punct)
    if method == "rlike":
        for name, kws in fam.items():
            out[name + suffix] = (pad(words).rlike(padded_pattern(kws))
                                  if kws else F.lit(False))
        return df.withColumns(out)
    if method != "ngram":
        raise ValueError(method)
    maxn = max((len(k.split(" ")) for k, _ in keywords), default=1)
    tok, tmp = "__toks", "__grams"
    toks = F.col(tok)
    n = F.size(toks)

    def gram(g):
        # g consecutive tokens starting at i, from the materialised token array
        return lambda i: F.concat_ws(" ", *[F.try_element_at(toks, i + j) for j in range(g)])
    grams = toks
    for g in range(2, maxn + 1):
        grams = F.concat(grams, F.transform(
            F.sequence(F.lit(1), F.greatest(n - g + 1, F.lit(1))), gram(g)))
    df2 = df.withColumn(tok, F.split(words, " ")).withColumn(tmp, grams).drop(tok)
    for name, kws in fam.items():
        out[name + suffix] = (F.arrays_overlap(F.col(tmp), F.array(*[F.lit(k) for k in kws]))
                              if kws else F.lit(False))
    return df2.withColumns(out).drop(tmp)


# --- relief disambiguation and determination (RL1-RL4) --------------------

def has_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Whole-token phrase test on normalised text (padded, engine-neutral)."""
    ph = [p for p in phrases if p]
    return pad(text).rlike(padded_pattern(ph)) if ph else F.lit(False)


def relief_flags(df: DataFrame, text: str, punct: str = "word", relief: str = "relief",
                 debt: str = "debt relief",
                 bad: Sequence[str] = tuple(BAD_RELIEF_PHRASES)) -> DataFrame:
    """Contains relief / bad relief / debt relief (normalised text). The
    three word lists default to the reference's and are parameters."""
    bad_n = [k for k, _ in normalise_keywords([(p, "") for p in bad], punct)]
    t = words_only(F.col(text), punct)
    return df.withColumns({
        "Contains bad relief": has_phrase(t, bad_n),
        "Contains debt relief": has_phrase(t, [debt]),
        "Contains relief": has_phrase(t, [relief]),
    })


def relief_rule(df: DataFrame, kw: str = "Crisis finance keyword match",
                variant: str = "r") -> DataFrame:
    """RL1 + RL2: plain "relief" (not a bad-relief name, not debt relief)
    counts as a keyword match; flag rows matching only on debt relief; the
    R form then also counts debt relief as a match."""
    k = F.col(kw)
    relief_ok = F.col("Contains relief") & ~F.col("Contains bad relief") \
        & ~F.col("Contains debt relief")
    df = df.withColumn(kw, k | relief_ok)
    df = df.withColumn("Only debt relief", F.col("Contains debt relief") & ~F.col(kw))
    if variant == "r":
        df = df.withColumn(kw, F.col(kw) | F.col("Contains debt relief"))
    return df


def _ord(c: Column) -> Column:
    return F.when(c == YES, 2).when(c == REVIEW, 1).otherwise(0)


def _from_ord(c: Column) -> Column:
    return F.when(c == 2, YES).when(c == 1, REVIEW).otherwise(NO)


def determine(df: DataFrame, prefix_cf: str = "Crisis finance",
              labels: Sequence[str] = ("PAF", "AA"), model_suffix: str = " predicted ML",
              kw_suffix: str = " keyword match") -> DataFrame:
    """RL3: three-way determination.

    CF: Yes if (identified or eligible) and keyword and model; Review if
    (identified or eligible) and keyword only; identified forces Yes; a Yes
    that rests only on debt relief drops to Review. Other labels: Yes if
    keyword and model, Review if keyword only, else No.
    """
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    ident, elig = b(f"{prefix_cf} identified"), b(f"{prefix_cf} eligible")
    kw, model = b(prefix_cf + kw_suffix), b(prefix_cf + model_suffix)
    cf = (F.when((ident | elig) & kw & model, YES)
          .when((ident | elig) & kw, REVIEW).otherwise(NO))
    cf = F.when(ident, YES).otherwise(cf)
    only_debt = b("Only debt relief") if "Only debt relief" in df.columns else F.lit(False)
    cf = F.when((cf == YES) & only_debt, REVIEW).otherwise(cf)
    out = {f"{prefix_cf} determination": cf}
    for lab in labels:
        k, m = b(lab + kw_suffix), b(lab + model_suffix)
        out[f"{lab} determination"] = F.when(k & m, YES).when(k, REVIEW).otherwise(NO)
    return df.withColumns(out)


def propagate_determination(df: DataFrame, chain: Sequence[str] = ("AA", "PAF", "Crisis finance"),
                            humanitarian: str | None = "humanitarian") -> DataFrame:
    """RL4: child determinations raise their parents (No < Review < Yes, a
    Review never lowers a Yes); humanitarian forces CF Yes; an AA Yes marks
    the row humanitarian."""
    det = lambda l: f"{l} determination"
    for child, parent in zip(chain, chain[1:]):
        df = df.withColumn(det(parent), _from_ord(F.greatest(_ord(F.col(det(parent))),
                                                             _ord(F.col(det(child))))))
    if humanitarian:
        h = F.coalesce(F.col(humanitarian), F.lit(False))
        top, bottom = det(chain[-1]), det(chain[0])
        df = df.withColumn(top, F.when(h, YES).otherwise(F.col(top)))
        df = df.withColumn(humanitarian, h | (F.col(bottom) == YES))
    return df


def rule_flags(df: DataFrame, text_cols: Sequence[str], keywords: Sequence[tuple[str, str]],
               punct: str = "word", variant: str = "r", method: str = "rlike",
               text: str = "text", relief: str = "relief", debt: str = "debt relief",
               bad: Sequence[str] = tuple(BAD_RELIEF_PHRASES)) -> DataFrame:
    """The text side of the rule engine: joined and normalised text, keyword and relief flags. What
    follows needs the flags alone, so texts need not cross a join with model predictions."""
    from ..functions.text import join_text
    df = df.withColumn(text, norm_text(join_text(text_cols), punct))
    kws = normalise_keywords(keywords, punct, drop=(relief,) if variant == "r" else ())
    df = keyword_match(df, text, kws, method=method, punct=punct)
    df = relief_flags(df, text, punct, relief, debt, bad)
    return relief_rule(df, variant=variant)


def rule_engine(df: DataFrame, text_cols: Sequence[str], keywords: Sequence[tuple[str, str]], **options) -> DataFrame:
    """E1 end to end on a frame that already has code flags and
    ``<label> predicted ML`` columns: text -> keywords -> relief -> RL3 -> RL4.
    ``variant='r'`` drops the relief word from the keyword list (it is
    handled by RL1) and counts debt relief as a match; ``'py'`` keeps it."""
    return propagate_determination(determine(rule_flags(df, text_cols, keywords, **options)))
