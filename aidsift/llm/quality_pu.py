"""Quality by positive-unlabelled learning (operator 7).

Trusted positives are rows labelled 1; unlabelled rows are documents whatever
their label. With the class prior p, the non-negative risk

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

of the logistic loss is minimised by gradient steps; while the second part is
negative the step goes against it, as in non-negative PU learning. The score
is an additive model: each measure of a text is cut at quantiles of the
unlabelled rows and each interval has a weight.

Learning reads at most ``MAX_ROWS`` positives and as many unlabelled rows, the
first in the order of a hash of their id. The prior is the smoothed share of
label 1 among the labelled training rows.

A null or empty text has measures of zero and a score like any other. Without
positives every score is the prior. Rows that repeat an id are scored each on
its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .wordhash import flat, words

MAX_ROWS = 20_000
BINS = 12
STEPS = 600

#: Byte classes whose share of a text is measured.
CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "blank": [32], "line": [10], "stop": [46],
    "comma": [44], "pipe": [124], "mark": [33, 63], "symbol": [*b"#$%&*+/<=>@[\\]^_`{}~"], "quote": [*b"\"'()-:;"], "high": [*range(128, 256)],
}
MEASURES = [*CLASSES, "words", "word_length", "distinct", "distinct_pairs", "top", "lines"]


def measures(texts: pa.Array) -> np.ndarray:
    """[row, measure] of a batch."""
    data, off = flat(texts)
    out = np.zeros((len(off) - 1, len(MEASURES)))
    size = np.diff(off)
    code = np.full(256, len(CLASSES), dtype=np.int64)
    for i, letters in enumerate(CLASSES.values()):
        code[letters] = i
    for w in words(texts):
        rows = slice(w.first, w.first + w.rows)
        lo, hi = int(off[w.first]), int(off[w.first + w.rows])
        owner = np.repeat(np.arange(w.rows), size[rows])
        k = len(CLASSES) + 1
        count = np.bincount(owner * k + code[data[lo:hi]], minlength=w.rows * k).reshape(w.rows, k)
        out[rows, :len(CLASSES)] = count[:, :-1] / np.maximum(size[rows], 1)[:, None]
        n = np.diff(w.off)
        part = out[rows, len(CLASSES):]
        part[:, 0] = np.log1p(n)
        total = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        part[:, 1] = (total[w.off[1:]] - total[w.off[:-1]]) / np.maximum(n, 1)
        pairs, _ = w.grams(2)
        for r in range(w.rows):
            a, b = int(w.off[r]), int(w.off[r + 1])
            if b > a:
                _, c = np.unique(w.hashes[a:b], return_counts=True)
                part[r, 2], part[r, 4] = len(c) / (b - a), c.max() / (b - a)
                part[r, 3] = len(np.unique(pairs[a:b - 1])) / (b - 1 - a) if b - a > 1 else 1
        part[:, 5] = np.log1p(count[:, list(CLASSES).index("line")] / np.maximum(n, 1) * 100)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(measures(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    cuts: np.ndarray  # [measure, cut]
    weights: np.ndarray  # [measure * (cuts + 1)]
    bias: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The place of each measure's interval among the weights."""
        width = self.cuts.shape[1] + 1
        return np.stack([np.searchsorted(c, x[:, i], side="left") + i * width for i, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.columns(x)].sum(axis=1) + self.bias if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = STEPS, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative risk by full-batch Adam."""
    cuts = np.quantile(unlabelled, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    # the far ends of a measure, where junk lies, get intervals of their own
    ends = np.quantile(unlabelled, [0.005, 0.02, 0.05, 0.95, 0.98, 0.995], axis=0).T
    model = Model(np.sort(np.concatenate([cuts, ends], axis=1), axis=1), np.zeros(0), 0.0)
    at_p, at_u = model.columns(positive), model.columns(unlabelled)
    n = model.cuts.shape[0] * (model.cuts.shape[1] + 1)
    w = np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def back(at: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at.ravel(), np.repeat(g, at.shape[1]), n), g.sum())

    for t in range(1, steps + 1):
        zp, zu = w[at_p].sum(axis=1) + w[-1], w[at_u].sum(axis=1) + w[-1]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        plus = back(at_p, prior * (sp - 1) / len(zp))
        minus = back(at_u, su / len(zu)) - back(at_p, prior * sp / len(zp))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = plus + minus if risk >= 0 else -minus
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model | float:
    """A model of ``rows`` (doc_id, x) and ``labels`` (id, 0 or 1); the prior alone without positives."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")))
    share = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    prior = (share["k"] + 0.5) / (share["n"] + 1)

    def first(frame: DataFrame) -> np.ndarray:  # at most max_rows rows
        got = frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("x").collect()
        return np.array([r["x"] for r in got]).reshape(len(got), len(MEASURES))

    positive = first(rows.join(known.where("y = 1"), "doc_id", "left_semi"))
    unlabelled = first(rows)
    return fit(positive, unlabelled, prior) if len(positive) and 0 < prior < 1 else prior


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, ``score`` of each row, learnt from ``labels``."""
    rows = written(measured(docs, id_col, text_col), "measured")
    model = learn(rows, labels, id_col, label_col, max_rows)
    if not isinstance(model, Model):
        return rows.select("doc_id", F.lit(float(model)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
