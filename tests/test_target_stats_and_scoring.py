"""Target statistics, trees on them and batch scoring against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aidsift.operators import scoring as S
from aidsift.operators import select
from aidsift.operators import target_stats as TS


def test_ordered_target_stats(spark):
    """A hot level, levels seen once, a NULL level; more partitions than the hot level needs."""
    r = random.Random(1)
    rows = [(i, r.choice(["hot"] * 6 + ["b", None, f"rare{i}"]), r.choice("xy"), float(r.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, f string, g string, y double").repartition(7)
    prior = sum(x[3] for x in rows) / len(rows)
    assert TS.prior_of(df, "y") == pytest.approx(prior)
    got = {x["id"]: (x["f_ts"], x["g_ts"]) for x in TS.ordered_target_stats(df, ["f", "g"], "y", "id", prior, 9).collect()}
    want, seen = {i: [None, None] for i, *_ in rows}, {}
    for i, f, g, y in sorted(rows, key=lambda x: (hashlib.md5(f"9:{x[0]}".encode()).hexdigest(), x[0])):
        for k, level in enumerate((f, g)):
            n, s = seen.get((k, level), (0, 0.0))
            want[i][k] = (s + prior) / (n + 1)
            seen[k, level] = (n + 1, s + y)
    assert len(got) == 600
    for i, w in want.items():
        assert got[i] == pytest.approx(w)


@pytest.mark.parametrize("few", [10_000, 0])
def test_new_rows(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW_GROUPS", few)
    train = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0), (3, None, 1.0)], "id int, f string, y double")
    stats = TS.level_stats(train, ["f"], "y")
    new = spark.createDataFrame([(10, "a"), (11, None), (12, "new")], "id int, f string")
    got = {x["id"]: x["f_ts"] for x in TS.apply_target_stats(new, stats, ["f"], "id", 0.5).collect()}
    assert got == pytest.approx({10: 1.5 / 3, 11: 1.5 / 2, 12: 0.5})


def test_a_hundred_thousand_levels(spark, tmp_path):
    """Trees of 32 bins on 100,000 levels; the saved model scores alike."""
    df = spark.range(200_000).select("id", F.concat(F.lit("l"), (F.col("id") % 100_000).cast("string")).alias("f"),
                                     (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 100_000) % 2).cast("double").alias("y"))
    model, held = TS.train_categorical_trees(df, "y", ["x"], ["f"], "id", {"maxDepth": [2], "maxIter": [3]})
    assert model.trees.stages[-1].getMaxBins() == 32
    assert TS.f1(held, "y") > 0.6  # half of the held-out rows have a training row of their level, which tells all
    model.save(str(tmp_path / "m"))
    again = TS.CategoricalTrees.load(spark, str(tmp_path / "m")).transform(held.select("id", "f", "x", "y"))
    a = {r["id"]: r["prediction"] for r in held.where("id < 2000").select("id", "prediction").collect()}
    assert a == {r["id"]: r["prediction"] for r in again.where("id < 2000").select("id", "prediction").collect()} and a


def test_score_pandas(spark):
    """Long, empty and missing texts; extra columns; a model that says what it was given."""
    texts = ["a b c d e f g", "", "z", None, "b " * 300 + "c", "a a a"]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id int, text string, extra array<int>").repartition(3)

    def load():
        return lambda part: np.array([[t.split(" ").count("a") / 10, len(t.split(" ")) / 100] for t in part])

    out = S.score_pandas(df, "text", load, ["p", "q"], max_tokens=3, t=0.15, batch_size=2)
    assert out.columns == ["id", "text", "extra", "p predicted", "p confidence", "q predicted", "q confidence"]
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["p confidence"] for i in range(6)] == pytest.approx([0.1, 0, 0, 0, 0, 0.3])
    assert [got[i]["q confidence"] for i in range(6)] == pytest.approx([0.03, 0.01, 0.01, 0, 0.03, 0.03])
    assert [got[i]["p predicted"] for i in range(6)] == [False, False, False, False, False, True]
    assert [got[i]["extra"] for i in range(6)] == [[i] for i in range(6)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert S.score_pandas(df.limit(0), "text", load, ["p", "q"]).collect() == []


def test_word_model(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["good", "bad", "of", "the"], weights=[1 + 4 * (i % 2), 3, 2, 2], k=20)), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string, y double")
    model = S.fit_word_model(df, "t", ["y"], words=3)
    assert len(model.weights) == 3 and model.weights["good"][0] > model.weights["bad"][0]
    conf = model(["good good", "bad", "unknown", ""])[:, 0]
    assert conf[0] > 0.5 > conf[1] and conf[2] == conf[3] == pytest.approx(1 / (1 + math.exp(-model.bias[0])))
    by_column = S.score_documents(df, "id", "t", model.column(["y"]), ["y"]).collect()
    assert [x["y confidence"] for x in by_column] == pytest.approx(model([x["t"] for x in by_column])[:, 0].tolist())


def test_folding_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b"), (1, None)], "id int, t string")
    scorer = lambda c: {"a": F.when(F.contains(c, F.lit("a")), 0.9).otherwise(0.1), "b": F.lit(0.7)}
    for out in (S.score_documents(df, "id", "t", scorer, ["a"]), S.cascade_chunk(df, "id", "t", [("a", scorer), ("b", scorer)])):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["a predicted"], r["a confidence"]) for r in out.collect()) == [(False, 0.0), (True, 0.9)]
