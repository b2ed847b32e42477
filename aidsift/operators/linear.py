"""Linear models over numbers and factors (ML12, ML13, AG25).

One pass over the rows sums products within each cell of factor levels (and
fold); the sums of cells give the Gram matrix of the one-hot columns, which
are never built. The matrix depends on the columns alone (``MAX_COLUMNS`` at most),
so models of any number of rows are solved from it on the driver:

* ``fit_linear``: least squares by Cholesky in column order; a column that those
  before it determine is aliased, as with treatment contrasts in R.
* ``fit_lasso``: cyclic coordinate descent along a path of penalties; the folds'
  training matrices are the whole less the fold, and a fold's error is a
  quadratic form of its matrix, so cross-validation reads no row again.

Rows with a missing value in any variable are left out (complete cases).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import seeded_key

MAX_COLUMNS = 1000
INTERCEPT, TARGET = "(Intercept)", "(target)"


def complete(df: DataFrame, y: str, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Rows without missing values, numbers as doubles and factors as strings."""
    rows = df.withColumns({c: F.col(c).cast("double") for c in (y, *num)} | {c: F.col(c).cast("string") for c in cat})
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in (y, *num)] + [F.col(c).isNotNull() for c in cat]
    return rows.where(reduce(lambda a, b: a & b, known))


@dataclass
class Gram:
    """Products of all columns: names, levels of each factor, matrix per fold (fold, column, column), and what was taken off each number."""

    names: list[str]
    levels: dict[str, list[str]]
    folds: np.ndarray
    shift: dict[str, float]

    @property
    def total(self) -> np.ndarray:
        return self.folds.sum(axis=0)


def gram(df: DataFrame, y: str, num: Sequence[str], cat: Sequence[str], folds: int = 1, id_col: str | None = None, seed: int = 42) -> Gram:
    """The Gram matrix of ``(Intercept)``, ``num``, ``<factor>_<level>`` of each factor (levels in order) and the target.

    Numbers are taken less their mean, which keeps the sums exact enough. ``folds`` deals rows by a seeded hash of ``id_col``.
    """
    rows = complete(df, y, num, cat)
    numbers = [*num, y]
    means = rows.agg(*[F.avg(c).alias(c) for c in numbers]).first().asDict()
    shift = {c: means[c] or 0.0 for c in numbers}
    fold = F.lit(0) if folds == 1 else (F.conv(F.substring(seeded_key(id_col, seed), 1, 8), 16, 10).cast("long") % folds).cast("int")
    x = {c: F.col(c) - F.lit(shift[c]) for c in numbers}
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i:]]
    cells = rows.groupBy(fold.alias("__fold"), *cat).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(x[c]).alias(f"__s{i}") for i, c in enumerate(numbers)],
        *[F.sum(x[a] * x[b]).alias(f"__p{i}") for i, (a, b) in enumerate(pairs)])
    name = {c: F.lit(TARGET if c == y else c) for c in numbers}
    level = {c: F.concat(F.lit(f"{c}_"), F.col(c)) for c in cat}
    entries = [(F.lit(INTERCEPT), F.lit(INTERCEPT), F.col("__n"))]
    entries += [(F.lit(INTERCEPT), name[c], F.col(f"__s{i}")) for i, c in enumerate(numbers)]
    entries += [(name[a], name[b], F.col(f"__p{i}")) for i, (a, b) in enumerate(pairs)]
    for i, c in enumerate(cat):
        entries += [(F.lit(INTERCEPT), level[c], F.col("__n"))] + [(level[c], level[d], F.col("__n")) for d in cat[i:]]
        entries += [(level[c], name[d], F.col(f"__s{j}")) for j, d in enumerate(numbers)]
    sums = cells.select("__fold", F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b"), v.alias("v")) for a, b, v in entries])).alias("e"))
    sums = sums.groupBy("__fold", "e.a", "e.b").agg(F.sum("e.v").alias("v"))
    levels = {c: sorted(r["l"] for r in rows.select(level[c].alias("l")).distinct().limit(MAX_COLUMNS + 1).collect()) for c in cat}
    names = [INTERCEPT, *num, *[x for ls in levels.values() for x in ls], TARGET]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"a linear model of more than {MAX_COLUMNS} columns")
    if len(set(names)) < len(names):
        raise ValueError("two columns or levels of one name")
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((folds, len(names), len(names)))
    for r in sums.collect():  # at most folds x columns x columns
        i, j = place[r["a"]], place[r["b"]]
        out[r["__fold"], i, j] = out[r["__fold"], j, i] = r["v"]
    return Gram(names, levels, out, shift)


@dataclass
class LinearFit:
    """Coefficients by name (None: aliased), and the sums of squares about the fit and the mean."""

    coefficients: dict[str, float | None]
    rows: int
    deviance: float
    null_deviance: float

    @property
    def pseudo_r2(self) -> float:
        """AG25: 1 - deviance / null deviance (NaN for a constant target)."""
        return 1.0 - self.deviance / self.null_deviance if self.null_deviance > 0 else float("nan")


def fit_linear(df: DataFrame, y: str, num: Sequence[str], cat: Sequence[str] = (), tolerance: float = 1e-10) -> LinearFit:
    """ML12: the Gaussian model of ``y`` on numbers and factors. A factor's first level is its base."""
    g = gram(df, y, num, cat)
    base = {ls[0] for ls in g.levels.values() if ls}
    names = [n for n in g.names[:-1] if n not in base]
    at = [g.names.index(n) for n in (*names, TARGET)]
    a = g.total[np.ix_(at, at)]
    size, k = np.diag(a).copy(), len(names)
    kept, lower = [], np.zeros((k + 1, k + 1))
    for j in range(k):
        rest = a[j, j] - lower[j, :j] @ lower[j, :j]
        if size[j] > 0 and rest > tolerance * size[j]:
            kept.append(j)
            lower[j, j] = np.sqrt(rest)
            lower[j + 1:, j] = (a[j + 1:, j] - lower[j + 1:, :j] @ lower[j, :j]) / lower[j, j]
    beta = np.zeros(k)
    if kept:
        part = lower[np.ix_(kept, kept)]
        beta[kept] = np.linalg.solve(part.T, lower[k, kept])
    n = g.total[0, 0]
    null = a[k, k] - a[0, k] ** 2 / n if n else 0.0
    coefficients = {x: float(beta[j]) if j in set(kept) else None for j, x in enumerate(names)}
    if kept:  # numbers were taken less their means
        coefficients[INTERCEPT] += g.shift[y] - sum(beta[names.index(c)] * g.shift[c] for c in num)
    return LinearFit(coefficients, int(n), float(max(a[k, k] - lower[k, :k] @ lower[k, :k], 0.0)), float(max(null, 0.0)))


def linear_predictor(coefficients: dict[str, float | None], num: Sequence[str], cat: Sequence[str]) -> Column:
    """The fitted value as a column; an unseen level counts as the base."""
    out = F.lit(float(coefficients.get(INTERCEPT) or 0.0))
    for c in num:
        if coefficients.get(c):
            out = out + F.lit(float(coefficients[c])) * F.col(c).cast("double")
    for c in cat:
        levels = [(n[len(c) + 1:], b) for n, b in coefficients.items() if n.startswith(f"{c}_") and b]
        if levels:
            table = F.create_map(*[F.lit(v) for pair in levels for v in pair])
            out = out + F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.lit(0.0))
    return out


@dataclass
class LassoFit:
    """Coefficients by name on the columns' own scale, the penalty chosen, and means and deviations of the columns."""

    coefficients: dict[str, float]
    penalty: float
    scale: dict[str, float]
    errors: list[tuple[float, float]]


def _moments(g: np.ndarray):
    """Deviations, correlations of the columns, covariances with the target, and means."""
    n = g[0, 0]
    mean = g[0] / n
    cov = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0.0))
    sd[sd <= 1e-12 * np.maximum(np.sqrt(np.diag(g)[1:-1] / n), 1e-300)] = 0.0  # constant columns stay out
    unit = np.where(sd > 0, sd, 1.0)
    corr = cov[1:-1, 1:-1] / np.outer(unit, unit)
    c = np.where(sd > 0, cov[1:-1, -1] / unit, 0.0)
    return sd, unit, corr, c, mean


def _path(g: np.ndarray, penalties: np.ndarray, tolerance: float = 1e-12, sweeps: int = 10_000) -> np.ndarray:
    """Coefficients (scaled columns) for each penalty, each begun from the one before."""
    sd, _, corr, c, _ = _moments(g)
    beta, out = np.zeros(len(sd)), []
    gradient = c.copy()
    for penalty in penalties:
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(sd > 0):
                pull = gradient[j] + beta[j]
                new = np.sign(pull) * max(abs(pull) - penalty, 0.0)
                if new != beta[j]:
                    gradient -= corr[:, j] * (new - beta[j])
                    moved, beta[j] = max(moved, abs(new - beta[j])), new
            if moved <= tolerance * max(np.abs(c).max(initial=0.0), 1e-300):
                break
        out.append(beta.copy())
    return np.array(out)


def _raw(g: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The weights of (Intercept) and the columns on their own scale."""
    _, unit, _, _, mean = _moments(g)
    b = beta / unit
    return np.concatenate([[mean[-1] - b @ mean[1:-1]], b])


def fit_lasso(df: DataFrame, y: str, num: Sequence[str], cat: Sequence[str] = (), id_col: str | None = None, folds: int = 10,
              steps: int = 60, ratio: float = 1e-4, seed: int = 42) -> LassoFit:
    """ML13: the lasso over numbers and all levels of the factors (no base), columns scaled to unit deviation, the
    penalty with the least cross-validated error."""
    g = gram(df, y, num, cat, folds, id_col, seed)
    total, names = g.total, g.names[1:-1]
    _, unit, _, c, _ = _moments(total)
    top = np.abs(c).max(initial=0.0)
    penalties = top * np.geomspace(1.0, ratio, steps)
    errors, n = np.zeros(steps), total[0, 0]
    for part in g.folds:
        if folds == 1 or part[0, 0] == 0 or part[0, 0] == n:
            continue
        rest = total - part
        for i, beta in enumerate(_path(rest, penalties)):
            v = np.append(_raw(rest, beta), -1.0)
            errors[i] += v @ part @ v / n
    best = int(np.argmin(errors)) if folds > 1 else steps - 1
    weights = _raw(total, _path(total, penalties[:best + 1])[-1])
    weights[0] += g.shift[y] - sum(weights[1 + names.index(x)] * g.shift[x] for x in num)
    return LassoFit(dict(zip([INTERCEPT, *names], map(float, weights))), float(penalties[best]), dict(zip(names, map(float, unit))),
                    list(zip(map(float, penalties), map(float, errors))))


def lasso_coefficients(fit: LassoFit, spark) -> DataFrame:
    """The intercept and the coefficients that are not zero, by name."""
    rows = [(n, b) for n, b in fit.coefficients.items() if n == INTERCEPT or b != 0.0]
    return spark.createDataFrame(rows, "variable string, beta double")


def lasso_optimality(df: DataFrame, fit: LassoFit, y: str, num: Sequence[str], cat: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """``variable, optimal``: whether each column meets the lasso's optimality conditions, from the residuals of the rows:
    its correlation with them equals the penalty with the sign of its coefficient, or is at most the penalty where that is zero."""
    rows = complete(df, y, num, cat).withColumn("__r", F.col(y) - linear_predictor(fit.coefficients, num, cat))
    n = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in num], F.avg("__r").alias("__r")).first().asDict()
    parts = [F.struct(F.lit(c).alias("variable"), ((F.col(c) - F.lit(n[c] or 0.0)) * F.col("__r")).alias("v")) for c in num]
    parts += [F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("variable"), F.col("__r").alias("v")) for c in cat]
    sums = rows.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.variable").agg(F.sum("p.v").alias("v"))
    known = df.sparkSession.createDataFrame([(k, fit.coefficients[k], s) for k, s in fit.scale.items()], "variable string, beta double, sd double")
    pull = F.col("v") / F.lit(float(max(n["n"], 1))) / F.col("sd")
    slack = F.lit(tolerance * max((p for p, _ in fit.errors), default=0.0))
    optimal = F.when(F.col("beta") == 0, F.abs(pull) <= fit.penalty + slack).otherwise(F.abs(pull - F.signum("beta") * fit.penalty) <= slack)
    return sums.join(F.broadcast(known), "variable").select("variable", optimal.alias("optimal"))
