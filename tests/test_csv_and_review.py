"""Split CSV files, review merges, sheets and the label table on small tables."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aidsift.operators import enrich as E
from aidsift.operators import review as RV
from aidsift.operators import training as TR
from aidsift.sources import csv_records as CSV
from aidsift.sources import files as IO


def write(path, rows, newline):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["id", "text", "more"])
        w.writerows(rows)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 700, 10_000_000])
def test_csv_splits(spark, tmp_path, newline, size):
    """Splits that begin in a field, end in one, or lie within one; quotes, commas, blank lines, accents."""
    r = random.Random(size)
    rows = [[i, "".join(r.choices(['a', '"', ",", "\n", "\n\n", "é", " ", "word"], k=r.randrange(1, 40))) + "x", r.choice(["", "m", "a,b"])] for i in range(120)]
    rows += [[500, "long\n" * 300 + "end", "m"], [501, '"', "n"], [502, "last", ""]]
    write(tmp_path / "a.csv", rows, newline)
    write(tmp_path / "b.csv", [[900, "one\ntwo", ""]], newline)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = CSV.read_csv_splits(spark, str(tmp_path), "id int, text string, more string")
        if size == 64:
            assert got.select(F.col("id")).rdd.getNumPartitions() > 20
        found = Counter(tuple(x) for x in got.collect())
        plain = Counter(tuple(x) for x in IO.read_csv(spark, str(tmp_path), "id int, text string, more string").collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = Counter((i, t, m or None) for i, t, m in [*rows, [900, "one\ntwo", ""]])
    assert found == want
    if newline == "\n":
        assert plain == want


def test_csv_without_rows(spark, tmp_path):
    write(tmp_path / "a.csv", [], "\n")
    assert CSV.read_csv_splits(spark, str(tmp_path), "id int, text string, more string").collect() == []


def test_earlier_review(spark):
    auto = spark.createDataFrame([(1, "a", "Yes"), (2, "b", "Review"), (3, "c", "Yes"), (4, "d", "No"), (5, None, "Yes"), (6, "e", None), (7, "a", "Review")],
                                 "id int, key string, det string")
    review = spark.createDataFrame([("a", "PAF"), ("b", "Not PAF"), ("b", None), ("zz", "PAF"), (None, "Not PAF")], "key string, Review string")
    missed = spark.createDataFrame([("d",), ("d",), ("e",), ("a",), ("yy",)], "key string")
    out = RV.earlier_review(auto, review, missed, "key", "det")
    assert out.columns == ["id", "key", "det", "origin"]
    assert Counter((r["id"], r["origin"]) for r in out.collect()) == Counter(
        [(1, "new"), (7, "new"), (3, "old"), (4, "missed"), (6, "missed"), (1, "missed"), (7, "missed")])
    assert {r["det"] for r in out.collect()} == {"Yes"}
    assert Counter(tuple(r) for r in RV.review_gaps(auto, review, missed, "key", "det").collect()) == Counter([("review", "zz"), ("missed", "yy")])


def test_sheets_and_decisions(spark, tmp_path):
    rows = [(i, "PAF" if i % 2 else "AA", 2017 + i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, sheet string, year int")
    log = spark.createDataFrame([(1, 1, "drop"), (1, 2, "keep"), (2, 5, "drop"), (2, 4, "keep"), (None, 1, "drop"), (99, 1, "drop")], "id int, at int, what string")
    kept = RV.apply_decisions(df, log, "id", ["at"], "what", "drop")
    assert {r["id"] for r in kept.collect()} == set(range(30)) - {2}
    root = str(tmp_path / "sheets")
    RV.write_sheets(kept, root)
    whole = sorted(tuple(r) for r in RV.read_sheets(spark, root).select("id", "sheet", "year").collect())
    RV.write_sheets(kept, root)  # a rerun changes nothing
    RV.write_sheets(kept.where("sheet = 'AA' and year = 2018"), root)
    assert whole == sorted(tuple(r) for r in RV.read_sheets(spark, root).select("id", "sheet", "year").collect())
    part = RV.read_sheets(spark, root, (F.col("sheet") == "AA") & (F.col("year") > 2017))
    assert {(r["sheet"], r["year"]) for r in part.collect()} == {("AA", 2018), ("AA", 2019)}
    assert "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: []", "")


def test_label_table(spark):
    reg = spark.createDataFrame([(1, "one", None), (2, "two", "b"), (3, "three", "c"), (4, None, None), (None, "none", "d")], "k int, title string, long string")
    crisis = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    paf = spark.createDataFrame([(2, "Both", "Yes", "No"), (3, "Part PAF", None, "Yes"), (8, "odd", "No", None)], "k int, typ string, ddo string, cont string")
    aa = spark.createDataFrame([(2, "Direct"), (3, None), (4, "Indirect")], "k int, kind string")
    table, conflicts = TR.label_table(reg, crisis, paf, aa, ["k"], ["title", "long"], "typ", "kind", "ddo", "cont")
    assert sorted(tuple(r) for r in table.collect()) == sorted([
        ("one", "Crisis financing"), ("two b", "Crisis financing,PAF,Direct,Indirect,WB CAT DDO,AA"), ("three c", "Crisis financing,PAF,Part,Contingent financing,AA"),
        ("", "Crisis financing,PAF,Indirect,AA"), ("none d", "Crisis financing"), ("", "Crisis financing"), ("", "Crisis financing,PAF")])
    assert [r["k"] for r in conflicts.collect()] == [2]


def test_classified_sheets(spark):
    paf = spark.createDataFrame([(1, "PAF"), (2, "Not PAF"), (3, None), (None, "Not PAF")], "id int, Classification string")
    aa = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    a, b = E.classified_sheets(paf, aa, "id")
    assert [r["id"] for r in a.collect()] == [1] and sorted(r["id"] for r in b.collect()) == [1, 3]
