"""Keyword tables, top values and nearest vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aidsift.operators import aggregate as A
from aidsift.operators import keywords as KW
from aidsift.operators import models as ML
from aidsift.operators import rules as R


def test_keyword_flags(spark):
    r = random.Random(1)
    words = ["flood", "risk", "of", "the", "cash", "aid", "early", "action", "x"]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(0, 12)))) for i in range(80)] + [(80, None), (None, "flood risk"), (5, "early action early"), (81, "")]
    kws = [(" ".join(r.choices(words, k=n)).title() + r.choice(["", "!", " "]), c) for n in (1, 2, 3, 5) for c in ("CF", "PAF", "AA") for _ in range(3)
           if n > 1 or c == "CF"]
    kws = [k for k in kws if k[0].lower().strip(" !") not in ("of", "the")] + [("", "CF"), (None, "AA"), ("...", "PAF"), ("absent words", "AA")]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(kws, "keyword string, category string")
    got = KW.keyword_flags(df, "id", "text", table, punct="ascii")
    norm = R.normalise_keywords([k for k in kws if k[0]], "ascii")
    held = {}
    for i, t in texts:
        held.setdefault(i, set()).update(c for k, c in norm if t is not None and f" {k} " in f" {t} ")
    want = Counter((i, *[bool(held[i] & set(cats)) for cats in R.LABEL_FAMILIES.values()]) for i, _ in texts)
    assert Counter(tuple(x) for x in got.collect()) == want
    assert any(w[1] for w in want) and any(not w[1] for w in want)
    none = KW.keyword_flags(df, "id", "text", table.limit(0), punct="ascii").collect()
    assert len(none) == len(texts) and not any(x[1] or x[2] or x[3] for x in none)


def test_a_million_keywords(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("word "), F.col("id"), F.lit(" end")).alias("keyword"), F.lit("CF").alias("category"))
    df = spark.createDataFrame([(1, "a word 777777 end b"), (2, "word 1000000 end"), (3, "word 5 ends"), (4, "word 0 end")], "id int, text string")
    got = {x["id"]: x["Crisis finance keyword match"] for x in KW.keyword_flags(df, "id", "text", table, punct="ascii").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_keyword_tables_that_fit_shuffle_no_tokens(spark, monkeypatch):
    """The broadcast form and the salted one give the same flags; the first joins tokens where they are."""
    texts = [(i, "early flood of cash aid " * (i % 3) + "x") for i in range(30)] + [(None, "flood of cash")]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([("flood of", "CF"), ("aid x", "PAF"), ("early", "AA"), ("of the", "CF")], "keyword string, category string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = KW.keyword_flags(df, "id", "text", table, punct="ascii")
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [token" in plan and "SortMergeJoin [token" not in plan and "hashpartitioning(token" not in plan
        monkeypatch.setattr(KW, "BROADCAST_ROWS", 0)
        many = KW.keyword_flags(df, "id", "text", table, punct="ascii")
        assert "SortMergeJoin [token" in many._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = Counter(tuple(x) for x in few.collect())
    assert got == Counter(tuple(x) for x in many.collect()) and {x[1:] for x in got} >= {(True, True, True), (False, False, False)}


@pytest.mark.parametrize("tracked", [4096, 16])
def test_top_values(spark, monkeypatch, tracked):
    """Sure of the sketch's candidates, and counting all where it is not."""
    monkeypatch.setattr(A, "TRACKED", tracked)
    r = random.Random(2)
    values = [r.choice(["a", "b", "c", None]) for _ in range(300)] + [f"rare{i}" for i in range(3000)] + ["d"] * 40 + ["e"] * 40
    r.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    want = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 5, 8):
        assert sorted(((x["value"], x["n"]) for x in A.top_values(df, "v", k).collect()), key=lambda x: (-x[1], x[0])) == want[:k]
    assert A.top_values(df.limit(0), "v", 3).collect() == []
    assert [x["share"] for x in A.top_values(df, "v", 1).collect()] == [want[0][1] / len(values)]


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(ML, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(120)]
    vectors += [(200, vectors[3][1]), (201, [2 * x for x in vectors[3][1]]), (202, None), (203, [0.0] * 6), (204, [float("nan")] * 6), (205, [1.0, 2.0]),
                (206, [1e30] * 6), (207, [None] + [1.0] * 5)]
    df = spark.createDataFrame(vectors, "id long, e array<float>").repartition(5)
    asked = df.where("id % 10 = 0 or id > 199")
    got = {}
    for x in ML.nearest_vectors(df, asked, "id", "e", 7).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["neighbour"], x["cos"]))
    good = [(i, np.array(v, dtype=float)) for i, v in vectors if v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    for i, v in good:
        if i % 10 and i < 200:
            continue
        cos = sorted(((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i))[:7]
        found = sorted(got.pop(i))
        assert [r for r, _, _ in found] == list(range(1, 8))
        assert [c for _, _, c in found] == pytest.approx([-c for c, _ in cos], abs=1e-9)
        assert len({n for _, n, _ in found}) == 7 and i not in {n for _, n, _ in found}
    assert got == {}  # vectors that are no vectors, and the only one of its length
    assert ML.nearest_vectors(df.limit(0), asked, "id", "e", 7).collect() == [] == ML.nearest_vectors(df, asked.limit(0), "id", "e", 7).collect()
