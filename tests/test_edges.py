"""Hand-made edge tables (FIXTURES.md §3) with literal expected rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aidsift.functions import labels as L
from aidsift.functions import numeric as N
from aidsift.functions import text as X
from aidsift.operators import aggregate as A
from aidsift.operators import link as K
from aidsift.operators import merge as M
from aidsift.operators import rules as R
from aidsift.operators import sample as S
from aidsift.operators import scoring as SC


# --- keys_null: JN2, JN3, JN8/JN9, SET6 -------------------------------------

def test_full_merge_null_equals_null(spark):
    a = spark.createDataFrame([(1, None, "a1"), (2, "x", "a2"), (3, "y", "a3")], "k1 int, k2 string, va string")
    b = spark.createDataFrame([(1, None, "b1"), (2, "x", "b2"), (4, "z", "b4")], "k1 int, k2 string, vb string")
    got = sorted(M.full_merge(a, b, ["k1", "k2"]).collect(), key=lambda r: r.k1)
    assert [tuple(r) for r in got] == [(1, None, "a1", "b1"), (2, "x", "a2", "b2"), (3, "y", "a3", None),
                                      (4, "z", None, "b4")]


def test_merge_coalesce_conflicts(spark):
    a = spark.createDataFrame([(1, None, 10), (2, "x", None), (3, "y", 5)], "k1 int, k2 string, v int")
    b = spark.createDataFrame([(1, None, 11), (2, "x", 7), (4, "z", 1)], "k1 int, k2 string, v int")
    merged, conflicts = M.merge_coalesce(a, b, ["k1", "k2"], ["v"])
    got = {r.k1: (r.v, r.conflict) for r in merged.collect()}
    assert got == {1: (10, True), 2: (7, False), 3: (5, False), 4: (1, False)}
    assert conflicts.count() == 1


def test_semi_anti_null_safe(spark):
    a = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    b = spark.createDataFrame([(None,), ("a",)], "k string")
    assert sorted([r.k or "~" for r in M.semi(a, b, "k").collect()]) == ["a", "~"]
    assert [r.k for r in M.anti(a, b, "k").collect()] == ["b"]


def test_set_partition(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    got = {r.k: r.side for r in M.set_partition(a, b, ["k"]).collect()}
    assert got == {1: "A only", 2: "both", 3: "B only"}


# --- link_a / link_b: JN11-JN17, AG16 ---------------------------------------

def test_date_bounds(spark):
    df = spark.createDataFrame([("2015-01-01|2019-02-02",), ("n/a|2020",), ("bad|x",), ("",)], "d string")
    lo, hi = K.date_bounds("d")
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(2015, 2019), (2020, 2020), (9999, 0), (9999, 0)]


def test_lookup_last_wins(spark):
    dim = spark.createDataFrame([(4, "FR-3", 1), (4, "FR-6", 2), (2, "BE", 3)], "code int, ref string, pos int")
    got = {r.code: r.ref for r in K.lookup_last(dim, "code", "ref", "pos").collect()}
    assert got == {4: "FR-6", 2: "BE"}


def test_interval_join_long_and_short_spans(spark):
    a = spark.createDataFrame([(1, "o", 2018), (2, "o", 1950), (3, "p", 2018)], "id int, blk string, yr int")
    b = spark.createDataFrame([(10, "o", 2017, 2019), (11, "o", 1900, 2100), (12, "o", 9999, 0)],
                              "bid int, bblk string, lo int, hi int")
    got = sorted((r.id, r.bid) for r in K.interval_join(a, b, "blk", "bblk", "yr", "lo", "hi").collect())
    assert got == [(1, 10), (1, 11), (2, 11)]


@pytest.mark.parametrize("method,anchor", [("hash", "rarest"), ("token", "rarest"), ("token", "sampled"),
                                           ("token", "longest")])
def test_contains_join_methods_agree(spark, method, anchor):
    a = spark.createDataFrame([(1, "the quick brown fox"), (2, "Brown"), (3, "lazy dog sleeps"), (4, None)],
                              "aid int, s string")
    b = spark.createDataFrame([(10, "THE QUICK BROWN FOX jumps"), (11, "a brown fox"), (12, "the lazy dog sleeps here")],
                              "bid int, t string")
    got = sorted(tuple(r) for r in K.contains_join(a, b, "aid", "s", "bid", "t", method=method,
                                                   anchor=anchor, df_sample=0.5).collect())
    assert got == [(1, 10), (2, 10), (2, 11), (3, 12)]


def _link_frames(spark):
    a = spark.createDataFrame([
        # id, org, year, number, title, short, long
        (1, "XM-1", 2018, "P1", None, None, None),                   # identifier: 1 match
        (2, "XM-1", 2018, "XM-1-P2", None, None, None),              # already prefixed
        (3, "XM-1", 2018, "Q", "a" * 21, None, None),                # id 6 matches -> title
        (4, "XM-1", 2018, None, "b" * 20, "c" * 21, None),           # 20-char title skipped -> short
        (5, "XM-1", 2030, "P1", None, None, None),                   # year outside -> unmatched
        (6, "ZZ", 2018, "P1", None, None, None),                     # unmapped org -> unmatched
    ], "id int, org string, yr int, num string, title string, short string, long string")
    b = spark.createDataFrame(
        [(1, "XM-1", "XM-1-P1", "x", 2017, 2019), (2, "XM-1", "XM-1-P2", "y", 2017, 2019)]
        + [(10 + i, "XM-1", f"XM-1-Q{i}", ("a" * 21 if i == 0 else "") + ("c" * 21 if i == 1 else ""), 2017, 2019)
           for i in range(6)],
        "pos int, borg string, ident string, text string, lo int, hi int")
    return a, b


def test_link_cascade(spark):
    a, b = _link_frames(spark)
    out = K.link_cascade(a, b, a_id="id", a_block="org", number="num", texts=["title", "short", "long"],
                         b_pos="pos", b_ident="ident", b_text="text", b_block="borg", year="yr", b_lo="lo", b_hi="hi")
    got = {r.id: (r.matched_identifier, r.match_type) for r in out.collect()}
    assert got == {1: ("XM-1-P1", "identifier"), 2: ("XM-1-P2", "identifier"), 3: ("XM-1-Q0", "project title"),
                   4: ("XM-1-Q1", "short description"), 5: ("", ""), 6: ("", "")}


# --- rule_rows: RL1-RL4 -------------------------------------------------------

def test_determination_truth_table(spark):
    rows = []
    for ident in (False, True):
        for elig in (False, True):
            for kw in (False, True):
                for model in (False, True):
                    rows.append((ident, elig, kw, model))
    df = spark.createDataFrame(rows, "`Crisis finance identified` boolean, `Crisis finance eligible` boolean, "
                                     "`Crisis finance keyword match` boolean, `Crisis finance predicted ML` boolean")
    out = R.determine(df, labels=()).collect()
    for r in out:
        ident, elig, kw, model = r[0], r[1], r[2], r[3]
        exp = "Yes" if ident else ("Yes" if elig and kw and model else "Review" if elig and kw else "No")
        assert r["Crisis finance determination"] == exp


def test_relief_rule_and_propagation(spark):
    df = spark.createDataFrame([
        ("relief for floods",), ("catholic relief services",), ("debt relief programme",), ("nothing",)], "text string")
    df = df.withColumn("Crisis finance keyword match", F.lit(False))
    df = R.relief_rule(R.relief_flags(df, "text"), variant="r")
    got = [(r["Crisis finance keyword match"], r["Only debt relief"]) for r in df.collect()]
    assert got == [(True, False), (False, False), (True, True), (False, False)]
    d = spark.createDataFrame([("No", "No", "Review", False), ("No", "Review", "Yes", False), ("Yes", "No", "No", True)],
                              "`Crisis finance determination` string, `PAF determination` string, "
                              "`AA determination` string, humanitarian boolean")
    p = R.propagate_determination(d).collect()
    assert [(r[0], r[1], r[3]) for r in p] == [("Review", "Review", False), ("Yes", "Yes", True), ("Yes", "No", True)]


def test_keyword_methods_agree(spark):
    kws = R.normalise_keywords([("Cold wave", "CF"), ("FbF", "AA"), ("Forecast-based", "AA"), ("crises", "PAF")], "word")
    df = spark.createDataFrame([("a cold wave hit",), ("forecast based fbf",), ("crisis",), ("",)], "text string")
    a = [tuple(r) for r in R.keyword_match(df, "text", kws, method="rlike").drop("text").collect()]
    b = [tuple(r) for r in R.keyword_match(df, "text", kws, method="ngram").drop("text").collect()]
    assert a == b == [(True, False, False), (False, True, True), (False, False, False), (False, False, False)]


# --- blank_rows, text_rows, id_rows -------------------------------------------

def test_reset_blank_null_as_blank(spark):
    df = spark.createDataFrame([(None, "", "-", True, 0.9), ("t", "", "-", True, 0.9)],
                               "a string, b string, c string, p boolean, c1 double")
    got = [tuple(r)[-2:] for r in R.reset_blank(df, ["a", "b", "c"], ["p"], ["c1"]).collect()]
    assert got == [(False, 0.0), (True, 0.9)]


TEXTS = ["Réfugiés_du  Sahel!", "A$B x_y «q» l’eau", "tab\there nbsp  ", "  Multiple   blanks\n"]


def test_norm_text_word_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(X.norm_text("t", "word")).collect()]
    exp = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower().strip())).strip() for t in TEXTS]
    assert got == exp


def test_strip_lead_zero(spark):
    df = spark.createDataFrame([("007",), ("7",), ("1e5",), ("123456789012345678",), ("21-RR-FAO-007",), ("000",),
                                ("007.50",)], "s string")
    got = [r[0] for r in df.select(X.strip_lead_zero("s")).collect()]
    assert got == ["7", "7", "1e5", "123456789012345678", "21-RR-FAO-007", "0", "7.5"]


def test_label_functions(spark):
    df = spark.createDataFrame([("Crisis financing,PAF",), ("Crisis financing",), ("PAF,AA",)], "l string")
    got = [r[0] for r in df.select(L.drop_parent("l", "Crisis financing")).collect()]
    assert got == ["PAF", "Crisis financing", "PAF,AA"]
    mh = [r[0] for r in df.select(L.multi_hot(L.label_array("l"), ["Crisis financing", "PAF", "AA"])).collect()]
    assert mh == [[1.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 1.0]]


# --- conf_rows, chunk_rows -----------------------------------------------------

def test_most_confident_ties(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.9, 0.2), (0.6, 0.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(N.most_confident("a", "b")).collect()] == [0.5, 0.9, 0.0, 1.0]


@pytest.mark.parametrize("n,chunks", [(1, [1]), (512, [512]), (513, [257, 256]), (1024, [512, 512]),
                                      (1025, [342, 342, 341])])
def test_balanced_chunks(spark, n, chunks):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, t string")
    got = [r.n_tokens for r in SC.chunk(df, "t", 512).orderBy("chunk_no").collect()]
    assert got == chunks


# --- class_rows: WN4, AG8-AG10 -------------------------------------------------

def test_stratified_split_small_classes(spark):
    df = spark.createDataFrame([(i, "a") for i in range(20)] + [(100, "b")], "id int, c string")
    out = S.stratified_split(df, "c", 0.25, "id", 1).collect()
    assert sum(1 for r in out if r.c == "a" and r.split == "test") == 5
    assert [r.split for r in out if r.c == "b"] == ["train"]


def test_ranked_matches_window(spark):
    df = spark.range(0, 500).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("h", S.seeded_key("id", 9))
    r = S.ranked(df, [F.col("h")], ["g"]).select("id", "rank")
    from pyspark.sql import Window
    w = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h"))).select("id", "rank")
    assert r.exceptAll(w).count() == 0 and w.exceptAll(r).count() == 0


@pytest.mark.parametrize("tn,fp,fn,tp,acc,prec,rec,f1", [
    (513, 42, 1, 444, 0.9570, 0.9136, 0.9978, 0.9538),       # committed CF matrix
    (909, 89, 0, 2, 0.9110, 0.0220, 1.0000, 0.0430),         # committed PAF matrix
    (81013, 3, 60, 17, 0.9992, 0.8500, 0.2208, 0.3505),      # committed AA (categorical trees)
])
def test_metrics_from_committed_matrices(spark, tn, fp, fn, tp, acc, prec, rec, f1):
    cm = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    r = A.metrics(cm).first()
    assert (round(r.accuracy, 4), round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) == (acc, prec, rec, f1)


def test_metrics_empty_denominators(spark):
    cm = spark.createDataFrame([(10, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    r = A.metrics(cm).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_null_groups_stay(spark):
    """A NULL class is a class: nothing is lost from splits, rebalancing and duplicate flags."""
    from aidsift.operators import sample as SM
    df = spark.createDataFrame([(i, "a" if i % 3 else None, int(i % 4 == 0)) for i in range(24)], "id long, g string, y int")
    split = SM.stratified_split(df, "g", 0.5, "id").collect()
    assert len(split) == 24 and sum(r["split"] == "test" for r in split if r["g"] is None) == 4
    both = SM.rebalance(df, "y", "id", by=["g"]).collect()
    assert sum(r["g"] is None and r["y"] == 1 for r in both) == sum(r["g"] is None and r["y"] == 0 for r in both) == 2
    flags = {r["id"]: r["duplicated"] for r in SM.dup_flag(df, "g", "id").collect()}
    assert not flags[0] and flags[3] and not flags[1] and flags[2]


@pytest.mark.parametrize("method", ["hash", "token"])
def test_contains_join_repeated_ids(spark, method):
    """Two needles of one id, one id with two texts and equal rows: each pair of rows once."""
    a = spark.createDataFrame([(1, "o", "the quick fox"), (1, "o", "a lazy dog"), (2, "o", "a lazy dog"), (3, "p", "a lazy dog")],
                              "aid int, blk string, s string")
    b = spark.createDataFrame([(7, "o", "see the quick fox run"), (7, "o", "a lazy dog"), (8, "o", "a lazy dog"), (8, "o", "a lazy dog"),
                               (None, "o", "THE QUICK FOX")], "bid int, bblk string, t string")
    got = Counter(tuple(r) for r in K.contains_join(a, b, "aid", "s", "bid", "t", "blk", "bblk", method=method).collect())
    assert got == Counter([(1, 7), (1, None), (1, 7), (1, 8), (1, 8), (2, 7), (2, 8), (2, 8)])


def test_cascade_doc_gates_chunks(spark):
    """AA reads the chunks that PAF predicted, whatever PAF's minimum confidence; no text gives no class."""
    def scorer(c):
        return {k: F.when(F.contains(c, F.lit(k)), F.lit(0.7)).otherwise(F.lit(0.1)) for k in ("cf", "paf", "aa")}
    df = spark.createDataFrame([(1, "cf", "paf x aa y"), (2, "cf", "paf aa x y"), (3, "x", "paf aa"), (4, None, None), (5, "cf", None)],
                               "id int, text string, limited string")
    out = SC.cascade_doc(df, "id", [("cf", "text", scorer), ("paf", "limited", scorer), ("aa", "limited", scorer)],
                         {"paf": 0.9}, max_tokens=2).collect()
    got = {r["id"]: (r["cf predicted"], r["paf predicted"], r["paf confidence"], r["aa predicted"], r["aa confidence"]) for r in out}
    assert got == {1: (True, False, 0.7, False, 0.1), 2: (True, False, 0.7, True, 0.7), 3: (False, False, 0.0, False, 0.0),
                   4: (False, False, 0.0, False, 0.0), 5: (True, False, 0.0, False, 0.0)}


def test_training_table_merges(spark):
    from aidsift.operators import training as TR
    reg = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, title string")
    paf = spark.createDataFrame([(1, "D"), (2, "D"), (9, "I")], "k int, typ string")
    aa = spark.createDataFrame([(2, "I"), (1, None)], "k int, typ string")
    out, conflicts = TR.training_table(reg, {"PAF": paf, "AA": aa}, ["k"], ["title"], "typ", {"D": "Direct", "I": "Indirect"},
                                       implied={"AA": ["CF", "PAF"]})
    assert sorted(tuple(r) for r in out.collect()) == [("", "PAF,Indirect"), ("one", "CF,PAF,AA,Direct"), ("three", "Unrelated"),
                                                       ("two", "CF,PAF,AA,Direct")]
    assert [tuple(r) for r in conflicts.collect()] == [(2, "AA")]


@pytest.mark.parametrize("method", ["rlike", "ngram"])
def test_keywords_beside_symbols(spark, method):
    kws = R.normalise_keywords([("relief", "CF"), ("flood response", "CF"), ("risk", "AA")], "unicode")
    df = spark.createDataFrame([("cash+relief",), ("flood=response",), ("a risk+ cover",), ("brisk",)], "raw string")
    df = df.select(X.norm_text("raw", "unicode").alias("text"))
    got = [tuple(r) for r in R.keyword_match(df, "text", kws, method=method, punct="unicode",
                                             families={"CF": ["CF"], "AA": ["AA"]}).drop("text").collect()]
    assert got == [(True, False), (True, False), (False, True), (False, False)]


def test_dim_join_null_key(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, k string")
    d = spark.createDataFrame([(None, 5), ("x", 6)], "k string, v int")
    assert sorted((r["id"], r["v"]) for r in M.dim_join(a, d, "k", {"v": 0}).collect()) == [(1, 5), (2, 6), (3, 0)]


def test_training_table_has_whole_texts(spark, tmp_path):
    from hashlib import md5

    from aidsift.plans.registry import load_all
    texts = ["one", "one\ntwo", "one\ntwo\nthree\n\nfive ", "one\ntwo\nother", None, " \n\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["text_key"], r["labels"]) for r in load_all()["training_table_whole"][0](spark, str(tmp_path)).collect()}
    want = [("one", "Unrelated"), ("one two", "Unrelated"), ("one two three  five", "Crisis financing"), ("one two other", "PAF,Direct"), ("", "Unrelated")]
    assert got == {(md5(t.encode()).hexdigest(), x) for t, x in want}


def test_synthetic_explode_keeps_short_lines(spark, tmp_path):
    from aidsift.plans.registry import load_all
    lines = ["x" * n for n in range(1, 12)]
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "\n".join(lines) + "\n \t\n\n  ok  ")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["line_no"], r["label"], r["line"]) for r in load_all()["synthetic_explode_all"][0](spark, str(tmp_path)).collect())
    assert got == [*((i, "short", x) for i, x in enumerate(lines)), (13, "short", "ok")]
