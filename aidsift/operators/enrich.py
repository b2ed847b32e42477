"""Enrichment, review merge, version comparison and consolidation
(SC25-SC29, RL5-RL8)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pad, padded_pattern
from . import merge as M
from .link import recode_override
from .project import drop_zero

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results:
# imputed PAF shares by year for two pooled-fund keyword families (the
# second family overrides the first), the contingent-financing keyword
# families and lenders, the donor-type dictionary by bilateral/multilateral
# code and the development-bank override list.
# ---------------------------------------------------------------------------
SFERA_SHARE = {2017: 0.104, 2018: 0.088, 2019: 0.313, 2020: 0.044, 2021: 0.288, 2022: 0.26}
DREF_SHARE = {2017: 0.0, 2018: 0.0, 2019: 0.024, 2020: 0.072, 2021: 0.033, 2022: 0.117}
CONTINGENT_KEYWORDS = ["ddo", "deferred drawdown", "deferred draw down",
                       "disaster resilience program", "disaster resilience improvement program",
                       "contingent loan"]
CONTINGENT_DONORS = ["International Bank for Reconstruction and Development",
                     "International Development Association", "Asian Development Bank",
                     "Inter-American Development Bank"]
DONOR_TYPE_BY_CODE = {1: "Government and EU institutions", 3: "Government and EU institutions",
                      4: "Multilateral (including UN) agencies and funds", 6: "Private donors",
                      7: "Government and EU institutions", 8: "Government and EU institutions"}
MDB_NAMES = ["African Development Fund", "African Development Bank", "Asian Development Bank",
             "Caribbean Development Bank", "Development Bank of Latin America",
             "Inter-American Development Bank",
             "International Bank for Reconstruction and Development",
             "International Development Association"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def per_capita(usd, pop, scale: float = 1e6) -> Column:
    """SC25: ``usd * 1e6 / population`` (NULL when population is NULL or 0)."""
    return F.try_divide(_c(usd) * F.lit(scale), _c(pop))


def imputed_share(text, year, families: Sequence[tuple[str, Mapping[int, float]]] = (
        ("sfera", SFERA_SHARE), ("dref", DREF_SHARE)), default: float = 1.0) -> Column:
    """SC26: share by (keyword family, year) on normalised text; later
    families override earlier ones; no match -> ``default``. Literal maps,
    no join."""
    out = F.lit(default)
    for word, shares in families:
        m = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        hit = pad(_c(text)).rlike(padded_pattern([word]))
        out = F.coalesce(F.when(hit, F.try_element_at(m, _c(year))), out)
    return out


def imputed_amounts(df: DataFrame, cols: Sequence[str], share: str = "paf_imputed_share",
                    scale: float = 1e6, prefix: str = "paf_", suffix: str = "_imputed") -> DataFrame:
    """SC27: amounts x share (USD millions scaled to USD)."""
    return df.withColumns({f"{prefix}{c}{suffix}": _c(c) * F.lit(scale) * F.col(share) for c in cols})


def enrich_paf(df: DataFrame, text: str, donor: str, year: str, amounts: Sequence[str], share: str = "paf_imputed_share") -> DataFrame:
    """RL7, the stage of the PAF and AA sheets, after ``enrich``: contingent instruments, the imputed share of the year's pooled
    funds, and each amount and each amount per capita times the share (SC26-SC28). ``text`` is normalised."""
    out = df.withColumns({"contingent_financing": contingent_flag(text, donor), share: imputed_share(text, year)})
    out = imputed_amounts(out, amounts, share)
    return out.withColumns({f"paf_{c}_imputed_per_capita": F.col(f"{c}_per_capita") * F.col(share) for c in amounts})


def classified_sheets(paf: DataFrame, aa: DataFrame, key: str, classification: str = "Classification",
                      negative: str = "Not PAF") -> tuple[DataFrame, DataFrame]:
    """RL7: the PAF sheet without its rows classified ``negative`` (a missing class goes too, as R's subset drops it), and
    the AA sheet without the keys of those rows."""
    no = paf.where(F.col(classification) == negative).select(key)
    return paf.where(F.col(classification) != negative), M.anti(aa, no, key)


def contingent_flag(text, donor, words: Sequence[str] = tuple(CONTINGENT_KEYWORDS),
                    donors: Sequence[str] = tuple(CONTINGENT_DONORS)) -> Column:
    """SC28: 1 when the text names a contingent instrument and the lender is
    in the list, else NULL."""
    hit = pad(_c(text)).rlike(padded_pattern(list(words)))
    return F.when(hit & _c(donor).isin(list(donors)), F.lit(1))


def unpivot_years(df: DataFrame, id_cols: Sequence[str], years: Sequence[str],
                  year: str = "year", value: str = "population") -> DataFrame:
    """SC29: wide year columns -> (id, year int, value)."""
    long = df.unpivot(list(id_cols), list(years), year, value)
    return long.withColumn(year, F.col(year).try_cast("int"))


def enrich(df: DataFrame, *, amounts: Sequence[str], zero_cols: Sequence[str],
           code: str, name: str, groups: DataFrame | None = None, pop: DataFrame | None = None,
           flags: Sequence[tuple[DataFrame, Mapping]] = (), iso: str = "recipient_iso3_code",
           year: str = "year", donor_map: Mapping = DONOR_TYPE_BY_CODE,
           override: Sequence[str] = tuple(MDB_NAMES)) -> DataFrame:
    """RL7: drop zero rows -> donor type -> lending groups -> population and
    per-capita amounts -> fragile/small-state flags defaulting to 0."""
    out = drop_zero(df, zero_cols)
    out = out.withColumn("donor_type", recode_override(code, donor_map, name, override,
                                                       "Multilateral development banks"))
    if groups is not None:
        out = M.dim_join(out, groups, iso)
    if pop is not None:
        out = M.dim_join(out, pop, [iso, year])
        out = out.withColumns({f"{c}_per_capita": per_capita(c, "population") for c in amounts})
    for dim, defaults in flags:
        out = M.dim_join(out, dim, iso, dict(defaults))
    return out


def review_merge(auto: DataFrame, review: DataFrame, key: str, verdict: str = "Review",
                 positive: str = "PAF", negative: str = "Not PAF",
                 auto_hit: Column | None = None, child_hit: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """RL5: apply a human review to automatic hits.

    Returns ``(kept, child)``: ``kept`` = every reviewed-positive row, joined
    to its automatic hit when there is one (right join on the review key);
    ``child`` = automatic child-label hits whose key was *not* reviewed
    negative (null-safe anti join).
    """
    hits = auto.where(auto_hit) if auto_hit is not None else auto
    rev = review.select(key, verdict).distinct()
    pos = rev.where(F.col(verdict) == positive)
    kept = M.reviewed_join(hits, pos, key)
    neg = rev.where(F.col(verdict) == negative).select(key)
    ch = auto.where(child_hit) if child_hit is not None else auto
    return kept, M.anti(ch, neg, key)


def version_compare(manual: DataFrame, auto: DataFrame, key: str, hit: Column,
                    conf: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RL6: compare a manual list with an automatic run on a normalised key.

    known  = distinct manual keys present anywhere in the automatic table;
    missed = known keys the automatic run did not flag (NULL dropped);
    new    = flagged keys absent from the manual list (NULL dropped).
    Returns ``(missed rows, new rows, rate)``; new rows carry ``conf`` for a
    descending report sort.
    """
    known = M.known_keys(manual, auto, key)
    flagged = auto.where(hit).select(key).distinct()
    missed_k = M.except_keys(known, flagged, key)
    new_k = M.except_keys(flagged, manual, key)
    missed = M.semi(manual, missed_k, key)
    new = M.semi(auto.where(hit), new_k, key)
    n_known = known.select(F.count(F.lit(1))).scalar()
    rate = missed_k.agg(F.count(F.lit(1)).alias("missed")).select(
        "missed", n_known.alias("known"),
        F.coalesce(F.try_divide(F.col("missed").cast("double"), n_known.cast("double")), F.lit(0.0)).alias("miss_rate"))
    return missed, new, rate
