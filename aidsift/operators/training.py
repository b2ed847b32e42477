"""Training-table construction (ML17-ML19, SC18)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import recode
from ..functions.text import join_text, trim_ws
from . import merge as M
from .sample import halve_class, stratified_split


def evaluation_set(base: DataFrame, extra: DataFrame | None, label: str, id_col: str,
                   keep: Sequence[str], halve: str | None, test_size: float = 0.1,
                   seed: int = 42) -> DataFrame:
    """ML17: keep two classes, halve one, stratified test split, then append
    the other set's test rows."""
    d = base.where(F.col(label).isin(list(keep)))
    if halve is not None:
        d = halve_class(d, label, halve, id_col, seed)
    test = stratified_split(d, label, test_size, id_col, seed).where(F.col("split") == "test")
    if extra is not None:
        test = test.unionByName(extra.where(F.col("split") == "test"), allowMissingColumns=True)
    return test


def training_table(register: DataFrame, sheets: Mapping[str, DataFrame], keys: Sequence[str],
                   text_cols: Sequence[str], type_col: str | None = None,
                   type_map: Mapping[str, str] | None = None, empty: str = "Unrelated",
                   implied: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """ML18: merge labelled sheets onto the register (null-safe full merges:
    labelled rows that the register lacks stay), recode sub-types to labels,
    build the text and the label list; rows with no label -> ``empty``.
    Columns that several sheets share, such as the sub-type, take the first
    value set. ``implied`` names the labels that a sheet's rows get besides
    its own. Returns ``(table(text, labels), conflicts)``; ``conflicts`` holds
    the keys on which a sheet disagrees with an earlier one, and its name."""
    keys, merged, conflicts = list(keys), register, []
    for name, sheet in sheets.items():
        flagged = sheet.withColumn(f"is_{name}", F.lit(True))
        shared = [c for c in sheet.columns if c in merged.columns and c not in keys]
        if shared:
            merged, clash = M.merge_coalesce(merged, flagged, keys, shared)
            merged = merged.drop("conflict")
            conflicts.append(clash.select(*keys, F.lit(name).alias("sheet")))
        else:
            merged = M.full_merge(merged, flagged, keys, "full")
    if not conflicts:
        conflicts.append(register.select(*keys, F.lit("").alias("sheet")).where(F.lit(False)))
    from_sheets = {n: [n, *[m for m, up in (implied or {}).items() if n in up]] for n in
                   dict.fromkeys([*[u for up in (implied or {}).values() for u in up], *sheets])}
    parts = [F.when(F.coalesce(*[F.col(f"is_{m}") for m in of if m in sheets]), F.lit(n)) for n, of in from_sheets.items()]
    if type_col:
        parts.append(recode(type_col, type_map or {}))
    labels = F.concat_ws(",", *parts)
    out = merged.select(trim_ws(join_text(text_cols)).alias("text"),
                        F.when(labels == "", F.lit(empty)).otherwise(labels).alias("labels")).distinct()
    return out, M.union_all(*conflicts)


#: The sub-types of a sheet and the labels they stand for.
TYPE_LABELS = {"Direct": "Direct", "Indirect": "Indirect", "Both": "Direct,Indirect", "Part PAF": "Part"}
LABEL_COLUMNS = ("crisis_label", "paf_label", "direct_label", "ddo_label", "cf_label", "aa_label")


def label_table(register: DataFrame, crisis: DataFrame, paf: DataFrame, aa: DataFrame, keys: Sequence[str], text_cols: Sequence[str],
                paf_type: str, aa_type: str, ddo: str, contingent: str) -> tuple[DataFrame, DataFrame]:
    """ML18, PRJ12: the table(text, labels) of the register and its labelled sheets, and the conflicts.

    A PAF row is crisis finance too, an AA row PAF and crisis finance; sub-types become labels (``Both`` two of them), as do
    deferred-drawdown and contingent instruments (``Yes``). Sheets merge null-safe and in full: the first sheet's value stays, and
    keys on which AA and PAF disagree are conflicts (``keys, column``). The narrow sheets are merged first; the texts of the
    register meet them in one join.
    """
    keys = list(keys)
    yes = lambda c, label: F.when(F.col(c) == "Yes", F.lit(label))
    sheets = [
        crisis.select(*keys, F.lit("Crisis financing").alias("crisis_label")),
        paf.select(*keys, F.lit("Crisis financing").alias("crisis_label"), F.lit("PAF").alias("paf_label"), recode(paf_type, TYPE_LABELS).alias("direct_label"),
                   yes(ddo, "WB CAT DDO").alias("ddo_label"), yes(contingent, "Contingent financing").alias("cf_label")),
        aa.select(*keys, F.lit("Crisis financing").alias("crisis_label"), F.lit("PAF").alias("paf_label"), F.lit("AA").alias("aa_label"),
                  recode(aa_type, TYPE_LABELS).alias("direct_label"))]
    merged, conflicts = sheets[0].distinct(), []
    for sheet in sheets[1:]:
        shared = [c for c in sheet.columns if c in merged.columns and c not in keys]
        merged, clash = M.merge_coalesce(merged, sheet.distinct(), keys, shared)
        merged = merged.drop("conflict")
        conflicts.append(clash.select(*keys))
    out = M.full_merge(register, merged, keys, "full")
    labels = F.concat_ws(",", *LABEL_COLUMNS)
    table = out.select(join_text(text_cols).alias("text"), F.when(labels == "", F.lit("Unrelated")).otherwise(labels).alias("labels")).distinct()
    return table, M.union_all(*conflicts).distinct()


def explode_generated(df: DataFrame, text: str, label: str, min_len: int = 0,
                      id_cols: Sequence[str] = ()) -> DataFrame:
    """ML19 / UD6: one row per non-blank generated line longer than
    ``min_len`` (0: every one), inheriting the record's label."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    e = df.select(*id_cols, label, lines).withColumn("line", trim_ws(F.col("line")))
    return e.where(F.col("line").isNotNull() & (F.length("line") > min_len))


def render_template(df: DataFrame, mapping: DataFrame, key: str, template: str = "%s\n\n%s",
                    text: str = "text", out: str = "prompt") -> DataFrame:
    """SC18: instruction per label set from a mapping table (broadcast when
    small), formatted with the text; an unmapped key gives an error row
    (``prompt`` NULL, ``error`` set) instead of aborting the job."""
    from ..session import sized_broadcast
    m = sized_broadcast(mapping.select(F.col(key).alias("__k"), F.col("instruction")), 100_000)
    j = df.join(m, df[key] == m["__k"], "left")
    return j.withColumns({
        out: F.when(F.col("instruction").isNotNull(), F.format_string(template, F.col("instruction"), F.col(text))),
        "error": F.when(F.col("instruction").isNull(), F.concat(F.lit("unmapped label set: "), F.col(key).cast("string"))),
    }).drop("__k", "instruction")
