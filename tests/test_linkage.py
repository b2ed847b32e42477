"""Substring and interval joins against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aidsift.operators import link as K
from aidsift.operators import substring


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(3)
    words = ["river", "stone", "ä", "the", "of", "a", "hill-side", "x", "été", "and", "0", "42"]
    texts = [(r.randrange(40), r.choice("pq"), " ".join(r.choices(words, k=r.randrange(0, 60)))) for _ in range(120)] + [(7, "p", None), (8, None, "river stone")]
    needles = []
    for i in range(200):
        _, blk, t = r.choice(texts[:120])
        at = r.randrange(0, max(1, len(t)))
        needles.append((i % 150, blk, t[at:at + r.choice([1, 2, 3, 4, 7, 8, 15, 16, 17, 40, 90])].upper()))
    needles += [(900, "p", None), (901, "p", ""), (902, None, "river"), (903, "p", "not there at all"), (904, "p", "the" * 200)]
    return needles, texts


def brute(needles, texts):
    return Counter((a, b) for a, x, s in needles for b, y, t in texts if s and t is not None and x is not None and x == y and s.lower() in t.lower())


@pytest.mark.parametrize("method", ["hash", "token"])
@pytest.mark.parametrize("hot", [10_000, 3])
def test_contains_join(spark, frames, method, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    needles, texts = frames
    a = spark.createDataFrame(needles, "aid int, blk string, s string")
    b = spark.createDataFrame(texts, "bid int, bblk string, t string")
    got = K.contains_join(a, b, "aid", "s", "bid", "t", "blk", "bblk", method=method)
    assert Counter(tuple(x) for x in got.collect()) == brute(needles, texts)


def test_contains_join_plan_and_empty_tables(spark, frames):
    needles, texts = frames
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.createDataFrame(needles, "aid int, blk string, s string")
        b = spark.createDataFrame(texts, "bid int, bblk string, t string")
        for method in ("hash", "token"):
            for blocks in ((None, None), ("blk", "bblk")):
                plan = K.contains_join(a, b, "aid", "s", "bid", "t", *blocks, method=method)._jdf.queryExecution().executedPlan().toString()
                assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert K.contains_join(a.limit(0), b, "aid", "s", "bid", "t").collect() == []
    assert K.contains_join(a, b.limit(0), "aid", "s", "bid", "t").collect() == []


def test_anchors_of_a_needle_are_in_every_text_that_holds_it():
    r = random.Random(4)
    for _ in range(300):
        q, w = r.choice([(1, 1), (2, 2), (4, 5), (8, 9), (8, 30)])
        needle = bytes(r.choices(b"ab", k=w + q - 1 + r.randrange(20)))
        text = bytes(r.choices(b"abc", k=r.randrange(30))) + needle + bytes(r.choices(b"abc", k=r.randrange(30)))
        inside = set(substring.anchors(needle, q, w).tolist())
        assert inside and inside <= set(substring.anchors(text, q, w).tolist())


def test_interval_join_any_length(spark):
    r = random.Random(6)
    points = [(i, r.choice("xy"), r.choice([None, r.randrange(-50, 50), 10 ** 12])) for i in range(60)]
    spans = [(i, r.choice("xy"), lo, lo + r.choice([0, 1, 5, 63, 64, 65, 10 ** 6, -1])) for i, lo in enumerate(r.choices(range(-60, 60), k=60))]
    spans += [(100, "x", -(10 ** 13), 10 ** 13), (101, "x", None, 5), (102, "y", 3, None)]
    a = spark.createDataFrame(points, "id int, blk string, yr bigint")
    b = spark.createDataFrame(spans, "bid int, bblk string, lo bigint, hi bigint")
    for blocks in (("blk", "bblk"), (None, None)):
        got = Counter((x.id, x.bid) for x in K.interval_join(a, b, *blocks, "yr", "lo", "hi").collect())
        assert got == Counter((i, j) for i, x, p in points for j, y, lo, hi in spans
                              if (x == y or not blocks[0]) and None not in (p, lo, hi) and lo <= p <= hi)
    plan = K.interval_join(a, b, "blk", "bblk", "yr", "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert K.interval_join(a, b.where(F.lit(False)), "blk", "bblk", "yr", "lo", "hi").collect() == []


@pytest.mark.parametrize("widest", [1, 16])
def test_pairs_of_long_needles(spark, widest):
    """Needles of every gram size, up to whole texts."""
    r = random.Random(8)
    words = ["river", "stone", "été", "the", "of", "hill-side"]
    texts = [(i, " ".join(r.choices(words, k=r.choice([3, 12, 80])))) for i in range(60)]
    needles = [t[at:at + n] for _, t in texts for n in (5, 21, 23, 24, 47, 48, 70, 1000) for at in [r.randrange(20)]]
    needles = [s for s in needles if s] + ["not there " * 9]
    a = spark.createDataFrame([(0, s) for s in needles + needles[:9]], "__blk int, __s string")
    b = spark.createDataFrame([(0, i, t) for i, t in texts + texts[:4]], "__blk int, __b int, __t string")
    digests = {bytes(x["n"]): x["__s"] for x in a.select("__s", substring.digest(F.col("__s")).alias("n")).collect()}
    got = Counter((digests[bytes(x["__n"])], x["__b"]) for x in substring.substring_pairs(a, b, widest).collect())
    assert got == Counter((s, i) for s in set(needles) for i, t in texts + texts[:4] if s in t)


def test_a_long_needle_takes_one_row_of_the_index(spark, monkeypatch):
    """Whole texts as needles: what is kept between jobs does not grow with their length."""
    kept, cut = [], substring.cut_lineage
    monkeypatch.setattr(substring, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    r = random.Random(9)
    text = " ".join(str(r.randrange(10 ** 9)) for _ in range(10_000))
    a, b = spark.createDataFrame([(1, text)], "id int, s string"), spark.createDataFrame([(2, "x " + text), (3, "y")], "bid int, t string")
    assert [tuple(x) for x in K.contains_join(a, b, "id", "s", "bid", "t").collect()] == [(1, 2)]
    assert [df.count() for df in kept] == [1]


def test_cascade_counts_equal_needles_once(spark):
    """Rows with equal needles meet the needle's count, not its texts: no join of rows with single texts."""
    a = spark.createDataFrame([(i, "o", "the same title of many rows", 2015 + i % 3) for i in range(60)], "id int, org string, t string, yr int")
    b = spark.createDataFrame([(i, "o", f"n{i}", f"the same title of many rows, {i}", 2015, 2015 + (i == 3)) for i in range(7)],
                              "pos int, borg string, ident string, text string, lo int, hi int")
    out = K.link_cascade(a, b, a_id="id", a_block="org", number=None, texts=["t"], b_pos="pos", b_ident="ident", b_text="text", b_block="borg",
                         year="yr", b_lo="lo", b_hi="hi", over="over")
    got = Counter((x["yr"], x["matched_identifier"], x["over"]) for x in out.collect())
    assert got == {(2015, "", True): 20, (2016, "n3", False): 20, (2017, "", False): 20}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    counts = [i for i, x in enumerate(plan) if "Aggregate" in x and "__n_hits" in x and "__lo" in x]
    verified = [i for i, x in enumerate(plan) if "Join" in x and "Contains" in x]
    rows = [i for i, x in enumerate(plan) if "Join" in x and "__yr" in x and "__lo" in x]
    assert counts and verified and rows and rows[0] < counts[0] < verified[0]


def test_register_documents_are_not_shuffled_by_language(spark, tmp_path):
    from aidsift.plans.q_link import _register_link
    spark.createDataFrame([(i, f"title of document {i}, long enough\nsecond\nthird", x) for i, x in enumerate(["en", "fr", "de", "es", None] * 4)],
                          "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f'<html lang="en">title of document {i}, long enough</html>') for i in range(20)],
                          "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = _register_link(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" not in plan and "hashpartitioning(rblk" not in plan
    got = {x["doc_id"]: x["match_type"] for x in out.collect()}
    assert len(got) == 20 and "identifier" in got.values() and all(got[i] == "" for i in got if i % 5)
