"""Quantiles and draws by selection against plain sorts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aidsift.operators import aggregate as A
from aidsift.operators import sample as S
from aidsift.operators import select


@pytest.mark.parametrize("inside,few", [(7, 10_000), (10_000, 0)])
def test_exact_quantiles(spark, monkeypatch, inside, few):
    """Every bracket size and both ways to join groups; ties, outliers, one value, a NULL group, missing values."""
    monkeypatch.setattr(select, "INSIDE", inside)
    monkeypatch.setattr(select, "ACCURACY", 50)
    monkeypatch.setattr(select, "FEW_GROUPS", few)
    r = random.Random(1)
    rows = [(g, r.choice([r.gauss(0, 1), 3.0, r.random() * 1e9, None])) for g in ("a", "b", None) for _ in range(400)]
    rows += [("one", 2.5), ("same", 1.0), ("same", 1.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = {x["g"]: x for x in select.exact_quantiles(df, "v", ["g"], probs).collect()}
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, v in want.items():
        assert [got[g][f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(v), min(v), max(v))
    whole = select.exact_quantiles(df, "v", [], probs).collect()
    assert [whole[0][f"q{i}"] for i in range(6)] == pytest.approx(np.quantile([v for vs in want.values() for v in vs], probs).tolist(), rel=1e-12)
    assert select.exact_quantiles(df.where("g = 'none'"), "v", ["g"], probs).collect() == []


def test_quantile_plan_has_no_percentile(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = A.quantile_summary(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "NestedLoop" not in plan and "Window" not in plan


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("inside,few", [(1, 10_000), (10_000, 0)])
def test_draws(spark, monkeypatch, inside, few):
    monkeypatch.setattr(select, "INSIDE", inside)
    monkeypatch.setattr(select, "FEW_GROUPS", few)
    monkeypatch.setattr(select, "DIGITS", 1)
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None, f"rare{i % 40}"]), r.random() < 0.2) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, y boolean").repartition(4)
    classes = {}
    for i, g, _ in rows:
        classes.setdefault(g, []).append(i)
    test = {i for g, ids in classes.items() for i in order(ids, 42)[:int(len(ids) * 0.3)]}
    split = {x["id"]: x["split"] for x in S.stratified_split(df, "g", 0.3, "id", 42).collect()}
    assert len(split) == 500 and {i for i, s in split.items() if s == "test"} == test
    for n in (0, 1, 77, 500, 900):
        assert sorted(x["id"] for x in S.sample_n(df, n, "id", 3).collect()) == sorted(order(range(500), 3)[:n])
    assert {x["id"] for x in S.sample_n(df, 2, "id", 3, ["g"]).collect()} == {i for ids in classes.values() for i in order(ids, 3)[:2]}
    want = {i for i, _, y in rows if y}
    for g, ids in classes.items():
        neg = [i for i in ids if not rows[i][2]]
        want |= set(order(neg, 5)[:sum(rows[i][2] for i in ids)])
    assert sorted(x["id"] for x in S.rebalance(df, "y", "id", 5, ["g"], positive=True).collect()) == sorted(want)
    half = S.halve_class(df, "g", "a", "id", 6)
    assert half.columns == df.columns
    assert {x["id"] for x in half.collect()} == {i for i, g, _ in rows if g != "a"} | set(order(classes["a"], 6)[:len(classes["a"]) // 2])
    assert S.sample_n(df.limit(0), 5, "id", 1).collect() == []
