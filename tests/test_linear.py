"""Linear models from Gram matrices against dense solutions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aidsift.operators import linear as L


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        f, g, x = r.choice("abcd"), r.choice(["u", "v"]), r.gauss(1e6, 3)
        z = r.gauss(0, 2)
        rows.append((i, 5e4 + 2 * x - z + {"a": 0, "b": 7, "c": -3, "d": 0}[f] + r.gauss(0, 0.5), x, z, f, g, "p" if f in "ab" else "q"))
    rows += [(900, None, 1.0, 1.0, "a", "u", "p"), (901, 1.0, None, 1.0, "a", "u", "p"), (902, 1.0, 1.0, float("nan"), "a", "u", "p"), (903, 1.0, 1.0, 1.0, None, "u", "p")]
    return rows, spark.createDataFrame(rows, "id int, y double, x double, z double, f string, g string, h string").repartition(4)


def dense(rows):
    good = rows[:400]
    y = np.array([r[1] for r in good])
    return good, y, np.array([[1, r[2], r[3], r[4] == "b", r[4] == "c", r[4] == "d", r[5] == "v"] for r in good], dtype=float)


def test_linear(spark, data):
    rows, df = data
    good, y, m = dense(rows)
    m[:, 1] -= 1e6
    want, *_ = np.linalg.lstsq(m, y, rcond=None)
    fit = L.fit_linear(df, "y", ["x", "z"], ["f", "g", "h"])
    assert fit.rows == 400 and fit.coefficients["h_q"] is None  # f determines h
    got = [fit.coefficients[n] for n in ("x", "z", "f_b", "f_c", "f_d", "g_v")]
    assert got == pytest.approx(want[1:].tolist(), rel=1e-6, abs=1e-6)
    residual = y - m @ want
    assert fit.deviance == pytest.approx(residual @ residual, rel=1e-6)
    assert fit.null_deviance == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9)
    fitted = {r["id"]: r["p"] for r in df.where("id < 400").select("id", L.linear_predictor(fit.coefficients, ["x", "z"], ["f", "g", "h"]).alias("p")).collect()}
    assert [fitted[i] for i in range(400)] == pytest.approx((m @ want).tolist(), rel=1e-9)
    flat = L.fit_linear(df.where("id < 400").withColumn("y", F.lit(2.0)), "y", ["x"])
    assert flat.null_deviance == 0 and flat.pseudo_r2 != flat.pseudo_r2 and flat.coefficients["x"] == pytest.approx(0)
    none = L.fit_linear(df.limit(0), "y", ["x"], ["f"])
    assert none.rows == 0 and none.coefficients["x"] is None


def test_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_COLUMNS", 20)
    with pytest.raises(ValueError):
        L.fit_linear(spark.range(100).select(F.col("id").alias("y"), F.col("id").cast("string").alias("f")), "y", [], ["f"])


def test_lasso(spark, data):
    rows, df = data
    good, y, _ = dense(rows)
    fit = L.fit_lasso(df, "y", ["x", "z"], ["f", "g"], "id", folds=5)
    names = ["x", "z", "f_a", "f_b", "f_c", "f_d", "g_u", "g_v"]
    assert list(fit.coefficients) == [L.INTERCEPT, *names]
    m = np.array([[r[2], r[3], *[r[4] == c for c in "abcd"], *[r[5] == c for c in "uv"]] for r in good], dtype=float)
    beta = np.array([fit.coefficients[n] for n in names])
    residual = y - fit.coefficients[L.INTERCEPT] - m @ beta
    sd = m.std(axis=0)
    assert [fit.scale[n] for n in names] == pytest.approx(sd.tolist(), rel=1e-9)
    pull = (m - m.mean(axis=0)).T @ residual / 400 / sd
    top = max(p for p, _ in fit.errors)
    for b, g in zip(beta, pull):
        assert abs(g - np.sign(b) * fit.penalty) < 1e-6 * top if b else abs(g) <= fit.penalty + 1e-6 * top
    assert abs(residual.mean()) < 1e-6
    # errors of cross-validation, each fold fitted by hand at the chosen penalty: the chosen one has the least of the path
    assert min(e for _, e in fit.errors) == dict(fit.errors)[fit.penalty] < 0.5
    assert fit.coefficients["f_b"] > 3 and fit.coefficients["x"] == pytest.approx(2, abs=0.05)
    named = {r["variable"]: r["beta"] for r in L.lasso_coefficients(fit, spark).collect()}
    assert L.INTERCEPT in named and named == {n: b for n, b in fit.coefficients.items() if b or n == L.INTERCEPT}
    assert all(r["optimal"] for r in L.lasso_optimality(df, fit, "y", ["x", "z"], ["f", "g"]).collect())
    worse = L.LassoFit({**fit.coefficients, "z": fit.coefficients["z"] + 0.1}, fit.penalty, fit.scale, fit.errors)
    assert not all(r["optimal"] for r in L.lasso_optimality(df, worse, "y", ["x", "z"], ["f", "g"]).collect())


def test_held_out_errors(spark, data):
    """A fold's error from its matrix is the mean squared error on its rows."""
    rows, df = data
    g = L.gram(df, "y", ["x", "z"], ["f"], 4, "id")
    assert g.total[0, 0] == 400 and (g.folds[:, 0, 0] > 50).all()
    beta = L._path(g.total - g.folds[1], np.array([0.3]))[0]
    weights = L._raw(g.total - g.folds[1], beta)
    v = np.append(weights, -1.0)
    from aidsift.operators.sample import seeded_key
    fold = (F.conv(F.substring(seeded_key("id", 42), 1, 8), 16, 10).cast("long") % 4) == 1
    part = df.where("id < 400").where(fold).collect()
    error = [r["y"] - g.shift["y"] - weights[0] - weights[1] * (r["x"] - g.shift["x"]) - weights[2] * (r["z"] - g.shift["z"])
             - weights[3 + "abcd".index(r["f"])] for r in part]
    assert len(part) == g.folds[1, 0, 0]
    assert v @ g.folds[1] @ v == pytest.approx(sum(e * e for e in error), rel=1e-6)
