"""Chunked batch scoring (ML1-ML5, ML11, AG15, JN20, UD1-UD6).

Texts longer than the model window are cut into balanced chunks
(``k = ceil(n / max)`` chunks of ``ceil(n / k)`` tokens), every chunk is
scored, and chunk scores fold back to the document (any prediction, max
confidence). The document id travels with every chunk, so results join
back by key, never by position.

A scorer is either

* a ``ColumnScorer``: ``text Column -> {label: confidence Column}``, a JVM
  expression (fully codegen'd), or
* a model in Python (``score_pandas``): a list of texts -> an array of
  confidences, run on Arrow batches (one load per worker), for real models.
"""

from __future__ import annotations

import uuid
from typing import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.numeric import most_confident, propagate_conf

ColumnScorer = Callable[[Column], Mapping[str, Column]]


def whitespace_tokens(text: Column) -> Column:
    return F.split(text, " ")


def chunk(df: DataFrame, text: str, max_tokens: int = 512,
          tokenizer: Callable[[Column], Column] = whitespace_tokens,
          out: str = "chunk", detokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """ML1 / UD6: one row per balanced chunk: ``chunk_no`` (0-based),
    ``n_tokens`` and the chunk text. Texts within the window stay whole."""
    toks = tokenizer(F.col(text))
    detok = detokenize or (lambda a: F.array_join(a, " "))
    n = F.size(F.col("__tok"))
    k = F.ceil(n / F.lit(max_tokens))
    size = F.ceil(n / k).cast("int")
    d = df.withColumn("__tok", toks).withColumn("__size", F.when(n <= max_tokens, n).otherwise(size))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__tok") - 1, F.lit(0)), F.greatest(F.col("__size"), F.lit(1)))
    pieces = F.when(F.size("__tok") <= max_tokens, F.array(F.col(text))).otherwise(
        F.transform(starts, lambda s: detok(F.slice(F.col("__tok"), s + 1, F.col("__size")))))
    d = d.select("*", F.posexplode(pieces).alias("chunk_no", out))
    return d.withColumn("n_tokens", F.size(tokenizer(F.col(out)))).drop("__tok", "__size")


def chunk_array(text: Column, max_tokens: int = 512) -> Column:
    """ML1 as one array per row: the same balanced chunks as ``chunk``; a NULL
    text has none."""
    def pieces(toks: Column) -> Column:
        n = F.size(toks)
        size = F.greatest(F.ceil(n / F.ceil(n / F.lit(max_tokens))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), size)
        return F.when(n <= max_tokens, F.array(text)).otherwise(
            F.transform(starts, lambda s: F.array_join(F.slice(toks, s + 1, size), " ")))

    # a transform over the one token array names it, so that it is split once and not again for each chunk
    cut = F.element_at(F.transform(F.array(whitespace_tokens(text)), pieces), 1)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(cut)


def score_columns(df: DataFrame, text: str, scorer: ColumnScorer, suffix: str = " confidence") -> DataFrame:
    """Apply a Column scorer in place (JN20: no positional binding)."""
    return df.withColumns({f"{k}{suffix}": v for k, v in scorer(F.col(text)).items()})


_MODELS: dict[str, Callable] = {}


def score_pandas(df: DataFrame, text: str, load: Callable[[], Callable], labels: Sequence[str], max_tokens: int = 512, t: float = 0.5,
                 batch_size: int = 64) -> DataFrame:
    """ML2 / UD3 with a model in Python: ``df`` with ``<label> predicted`` and ``<label> confidence``.

    ``load()`` gives the model, once per Python worker; it takes a list of texts and gives an array (texts, labels) of
    confidences. The chunks of a batch's rows are laid end to end, scored in batches of like length, and
    folded back to their rows inside the same batch: nothing is shuffled and rows keep their place.
    A text without chunks (NULL) has confidence 0.
    """
    key, chunks = uuid.uuid4().hex, "__chunks"
    rows = df.withColumn(chunks, chunk_array(F.col(text), max_tokens))
    fields = [Ty.StructField(f"{l}{s}", kind()) for l in labels for s, kind in ((" predicted", Ty.BooleanType), (" confidence", Ty.DoubleType))]

    schema = Ty.StructType(df.schema.fields + fields)
    names = schema.names

    def run(batches):
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = load()
        model = _MODELS[key]
        for batch in batches:
            pieces = batch.column(batch.num_columns - 1)
            texts = pieces.flatten().to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            conf = np.zeros((len(texts), len(labels)))
            for i in range(0, len(order), batch_size):
                part = order[i:i + batch_size]
                conf[part] = model([texts[j] for j in part])
            count = np.array([len(p) if p is not None else 0 for p in pieces.to_pylist()], dtype=np.int64)
            best = np.zeros((len(count), len(labels)))
            starts = np.cumsum(count) - count
            if len(texts):
                best[count > 0] = np.maximum.reduceat(conf, starts[count > 0], axis=0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            for i in range(len(labels)):
                columns += [pa.array(best[:, i] > t), pa.array(best[:, i])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


class WordModel:
    """A fitted word model: confidence = sigmoid(bias + the words' weights), the mean over a text's known words."""

    def __init__(self, weights: Mapping[str, Sequence[float]], bias: Sequence[float]):
        self.weights, self.bias = {w: np.array(x, dtype=float) for w, x in weights.items()}, np.array(bias, dtype=float)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.bias)))
        for i, text in enumerate(texts):
            known = [self.weights[w] for w in text.split(" ") if w in self.weights]
            out[i] = self.bias + (sum(known) / len(known) if known else 0.0)
        return 1.0 / (1.0 + np.exp(-out))

    def column(self, labels: Sequence[str]) -> ColumnScorer:
        """The same model as a column expression."""
        def scorer(text: Column) -> dict[str, Column]:
            out = {}
            for i, label in enumerate(labels):
                table = F.create_map(*[F.lit(v) for w, x in self.weights.items() for v in (w, float(x[i]))])
                known = F.filter(F.transform(F.split(text, " "), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
                mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(F.lit(0.0))
                out[label] = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(self.bias[i])) + mean)))
            return out
        return scorer


def fit_word_model(df: DataFrame, text: str, labels: Sequence[str], words: int = 500, max_iter: int = 20) -> WordModel:
    """ML14: logistic models per label on the shares of the ``words`` most frequent words of ``text`` (blank-separated)."""
    toks = df.withColumn("__words", F.split(text, " "))
    vocabulary = CountVectorizer(inputCol="__words", outputCol="__tf", vocabSize=words).fit(toks)
    rows = Normalizer(inputCol="__tf", outputCol="features", p=1.0).transform(vocabulary.transform(toks))
    fitted = [LogisticRegression(labelCol=l, featuresCol="features", maxIter=max_iter).fit(rows) for l in labels]
    weights = {w: [float(m.coefficients[i]) for m in fitted] for i, w in enumerate(vocabulary.vocabulary)}
    return WordModel(weights, [float(m.intercept) for m in fitted])


def chunks_to_docs(df: DataFrame, id_col: str, labels: Sequence[str], t: float = 0.5,
                   thresholds: Mapping[str, float] | None = None,
                   conf_suffix: str = " confidence", pred_suffix: str = " predicted") -> DataFrame:
    """AG15: per document, predicted = any chunk above the threshold (and
    above the label's minimum-confidence gate, ML5), confidence = max."""
    th = thresholds or {}
    aggs = []
    for l in labels:
        c = F.col(f"{l}{conf_suffix}")
        aggs += [F.coalesce(F.bool_or((c > t) & (c > th.get(l, 0.0))), F.lit(False)).alias(f"{l}{pred_suffix}"),
                 F.coalesce(F.max(c), F.lit(0.0)).alias(f"{l}{conf_suffix}")]
    return df.groupBy(id_col).agg(*aggs)


def _confidence(scorer: ColumnScorer, label: str) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(scorer(c)[label].cast("double"), F.lit(0.0))


def _gated(conf: Callable[[Column], Column], t: float) -> Callable[[Column, Column], Column]:
    return lambda c, before: F.when(before > t, conf(c)).otherwise(F.lit(0.0))


def _folded(scores: Sequence[tuple[str, str]], t: float, thresholds: Mapping[str, float]) -> list[Column]:
    """Predictions and confidences of (label, column with the scores of its chunks)."""
    out = []
    for label, name in scores:
        bound = F.lit(max(t, thresholds.get(label, 0.0)))
        out += [F.coalesce(F.array_max(name) > bound, F.lit(False)).alias(f"{label} predicted"),
                F.coalesce(F.array_max(name), F.lit(0.0)).alias(f"{label} confidence")]
    return out


def score_documents(df: DataFrame, id_col: str, text: str, scorer: ColumnScorer, labels: Sequence[str],
                    max_tokens: int = 512, t: float = 0.5) -> DataFrame:
    """ML2 + AG15: chunk -> score every chunk -> fold, all inside the row: any chunk over the threshold, and the
    largest confidence. No shuffle; the text stays where it is. A NULL text has no chunk and no class."""
    out = df.withColumn("__chunks", chunk_array(F.col(text), max_tokens))
    out = out.withColumn("__s", F.transform("__chunks", lambda c: F.struct(*[_confidence(scorer, l)(c).alias(f"s{i}") for i, l in enumerate(labels)])))
    return out.select(*df.columns, *_folded([(l, f"__s.s{i}") for i, l in enumerate(labels)], t, {}))


def cascade_chunk(df: DataFrame, id_col: str, text: str, stages: Sequence[tuple[str, ColumnScorer]],
                  thresholds: Mapping[str, float] | None = None, max_tokens: int = 512,
                  t: float = 0.5) -> DataFrame:
    """ML3 + ML5: per chunk, stage i+1 is scored only where stage i predicted
    its class; a stage's confidence counts 0 on gated-out chunks. Documents
    then take any/max over their chunks, which lie in one row: no shuffle."""
    out = df.withColumn("__chunks", chunk_array(F.col(text), max_tokens))
    for i, (label, scorer) in enumerate(stages):
        conf = _confidence(scorer, label)
        scores = F.transform("__chunks", conf) if i == 0 else F.zip_with("__chunks", f"__s{i - 1}", _gated(conf, t))
        out = out.withColumn(f"__s{i}", scores)
    return out.select(id_col, *_folded([(l, f"__s{i}") for i, (l, _) in enumerate(stages)], t, thresholds or {}))


def cascade_doc(df: DataFrame, id_col: str, stages: Sequence[tuple[str, str, ColumnScorer]],
                thresholds: Mapping[str, float] | None = None, max_tokens: int = 512,
                t: float = 0.5) -> DataFrame:
    """ML4: document-gated cascade. The first stage reads whole documents; the
    later ones run only on documents it predicted, each on its own text
    column, and from the third on only on chunks of that column whose class
    the stage before predicted (confidence over ``t``; a minimum-confidence
    gate of ``thresholds`` after the first stage shapes a document's
    prediction, not the gating). A stage that reads another column than the
    one before it is gated by document. A gated-out chunk counts 0. All
    chunks of a document lie in one row, so scores are folded inside it: no
    shuffle, one output row per input row. ``stages`` = (label, text, scorer)."""
    th = thresholds or {}

    def above(name, bound):
        return F.coalesce(F.exists(name, lambda x: x > bound), F.lit(False))

    names = [f"__s{i}" for i in range(len(stages))]
    bounds = [max(t, th.get(label, 0.0)) for label, _, _ in stages]
    out, pieces = df, {}
    for i, (label, text, scorer) in enumerate(stages):
        if text not in pieces:
            pieces[text] = f"__chunks{len(pieces)}"
            out = out.withColumn(pieces[text], chunk_array(F.col(text), max_tokens))
        conf, zero = _confidence(scorer, label), F.transform(pieces[text], lambda c: F.lit(0.0))
        if i == 0:
            scores = F.transform(pieces[text], conf)
        elif i == 1 or stages[i - 1][1] != text:
            alive = above(names[i - 1], bounds[0] if i == 1 else t)
            scores = F.when(alive, F.transform(pieces[text], conf)).otherwise(zero)
        else:
            scores = F.zip_with(pieces[text], names[i - 1], _gated(conf, t))
        out = out.withColumn(names[i], scores)
    result = []
    for name, bound, (label, _, _) in zip(names, bounds, stages):
        result += [above(name, bound).alias(f"{label} predicted"), F.coalesce(F.array_max(name), F.lit(0.0)).alias(f"{label} confidence")]
    return out.select(id_col, *result)


def joint(df: DataFrame, labels: Sequence[str], a_suffix: str = " confidence",
          b_suffix: str = " confidence XGB", t: float = 0.5) -> DataFrame:
    """ML11: per label the more confident of two models (SC23), then
    child -> parent propagation (SC24, joint form) and ``>= t`` predictions.
    ``labels`` ordered parent first (CF, PAF, AA)."""
    out = df.withColumns({f"{l} confidence joint": most_confident(f"{l}{a_suffix}", f"{l}{b_suffix}")
                          for l in labels})
    chain = [f"{l} confidence joint" for l in reversed(labels)]
    out = propagate_conf(out, chain, t)
    return out.withColumns({f"{l} predicted joint": F.col(f"{l} confidence joint") >= t for l in labels})
