"""Toxicity by a lexicon trie and Levenshtein automata (operator 2).

Learning (labelled rows only, at most ``max_rows`` of them in the order of a
hash of their id): terms that nearly only toxic documents hold, as whole words and as
word beginnings of ``STEMS`` letters, form the lexicon; a logistic regression
weighs a document's matches.

Matching: the lexicon is a trie; a Levenshtein automaton (one edit from five
letters on, two from ten) runs over it from the root as a set of
(trie node, edits), and these sets are the states of a DFA that is built as
words need it. Words are runs of letters; neighbours with one or two digits or
signs between them, which cost an edit each, are also matched as one misspelt word.

Context: a match with a quotation mark or a reporting word within ``WINDOW``
words counts as quoted, a feature of its own, so that quotation does not
weigh as abuse does.

A null or empty text has no matches and gets the score of such documents.
Without labelled rows of both classes the lexicon is empty and every score is
the smoothed share of toxic rows. Rows that repeat an id are scored each on
its own; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .worker import kept, text_place

WORD = re.compile(r"[^\W\d_]+")
#: Up to two digits or signs between letters; more are more edits than any term may have.
GAP = re.compile(r"(?<=[^\W\d_])(?:[^\w\s]|[\d_]){1,2}(?=[^\W\d_])")
STEMS = (5, 6)
WINDOW = 6
#: Rows of labels that learning reads at most, and terms that the lexicon holds at most.
MAX_ROWS = 30_000
MAX_TERMS = 4_000
MIN_DOCS = 6
MIN_SHARE = 0.9
QUOTES = frozenset("\"“”„«»")
#: Words that report speech.
REPORTING = frozenset("said says called wrote quote quoted term word insult sagte schrieb nannte wort dijo escribió llamó palabra dit écrit appelé mot".split())
_MEMO = 400_000


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Matcher:
    """``match(word)``: 0 none, 1 a term, 2 a misspelt term, 3 a term's beginning."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.term, self.stem = [0], [-1], [False]
        for word, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            node, d = 0, 0 if is_stem else edits(word)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.term.append(-1)
                    self.stem.append(False)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], d)
            if is_stem:
                self.stem[node] = True
            else:
                self.term[node] = max(self.term[node], d)
        self.limit[0] = max(map(edits, terms), default=0)
        self.memo: dict[str, int] = {}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.dead = self._state(frozenset())

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.next.append({})
        return self.states[s]

    def _closed(self, at: set[tuple[int, int]]) -> frozenset:
        """With what deletions of the term's letters reach; the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = list(at)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(k, e + 1) for k in self.children[node].values() if e + 1 <= self.limit[k]]
        return frozenset(best.items())

    def _step(self, state: int, c: str) -> int:
        if c in self.next[state]:
            return self.next[state][c]
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            for k, child in self.children[node].items():
                cost = e + (k != c)
                if cost <= self.limit[child]:
                    after.add((child, cost))
            if e + 1 <= self.limit[node]:
                after.add((node, e + 1))
        self.next[state][c] = out = self._state(self._closed(after))
        return out

    def match(self, word: str) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            got = self.memo[word] = self._match(word)
        return got

    def _match(self, word: str) -> int:
        node, stem = 0, False
        for c in word:
            node = self.children[node].get(c, 0)
            if not node:
                break
            stem = stem or self.stem[node]
        if node and self.term[node] >= 0:
            return 1
        if stem:
            return 3
        state, step, dead = self._state(self._closed({(0, 0)})), self._step, self.dead
        for c in word:
            state = step(state, c)
            if state == dead:
                return 0
        return 2 if any(e <= self.term[n] for n, e in self.sets[state]) else 0


def matcher_of(terms: tuple[str, ...], stems: tuple[str, ...]) -> Matcher:
    """The matcher of this Python worker, with the states and words that its tasks have met."""
    return kept(Matcher, terms, stems)


def glued(matcher: Matcher, low: str, spans: list[re.Match]) -> dict[int, int]:
    """Of misspelt terms with digits or signs between their letters: the first of the
    words that make them up, and the one behind the last. Words that match as they are do not take part."""
    found = list(GAP.finditer(low))
    if not found:
        return {}
    starts, out, match = {m.start(): i for i, m in enumerate(spans)}, {}, matcher.match
    gaps = {starts[g.end()]: len(g[0]) for g in found}  # by the word behind the gap
    for i, size in gaps.items():
        ends = [i + 1, i + 2] if size == 1 and gaps.get(i + 1) == 1 else [i + 1]
        for e in ends:
            if match(low[spans[i - 1].start():spans[e - 1].end()]) == 2 and not any(match(m[0]) for m in spans[i - 1:e]):
                out[i - 1] = e
    return out


FEATURES = 5


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def doc_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(matcher: Matcher, text: str) -> list[float]:
    """log(1 + n) of terms, misspelt terms and beginnings outside quotation, of
    all in quotation, and the share of matched words."""
    match = matcher.match
    low = text.lower()
    words = WORD.findall(low)
    hit = {w: k for w in set(words) if (k := match(w))}
    if not hit and not GAP.search(low):  # most texts: places of words are not needed
        return [0.0] * FEATURES
    spans = list(WORD.finditer(low))
    joined = glued(matcher, low, spans)
    if not hit and not joined:
        return [0.0] * FEATURES
    counts = [0, 0, 0, 0]
    for i, m in enumerate(spans):
        if k := hit.get(m[0]) or 2 * (i in joined):
            near = spans[max(0, i - WINDOW):i + WINDOW + 1]
            around = low[near[0].start():near[-1].end() + 1]
            quoted = bool(QUOTES & set(around)) or any(x[0] in REPORTING for x in near)
            counts[3 if quoted else k - 1] += 1
    return [*(math.log1p(c) for c in counts), math.sqrt(sum(counts) / len(words))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (id, 0 or 1) names."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
              .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows))
    chosen = written(chosen, "chosen")
    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(weights=[0.0] * FEATURES + [math.log(share / (1 - share))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.join(F.broadcast(chosen), "id").select("id", "text", "y"), "labelled")  # at most max_rows ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def table() -> pa.RecordBatch:
            names = sorted(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[w] for w in names], pa.int64()) for s in seen)],
                                              names=["word", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(doc_words(text.as_py() or ""))
                seen[1 if y else 0].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
            yield table()
            seen[0].clear(), seen[1].clear()

    few = F.col("toxic") / (F.col("toxic") + F.col("clean") * (n1 / n0)) >= MIN_SHARE
    terms = (rows.select("text", "y").mapInArrow(count, "word string, clean long, toxic long")
             .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where((F.col("toxic") >= MIN_DOCS) & few & (F.col("clean") <= F.col("toxic") / 20))
             .orderBy(F.desc("toxic"), "word").limit(max_terms).select("word", "toxic").collect())
    docs_of = {r["word"]: r["toxic"] for r in terms}
    words = [w for w in docs_of if not w.endswith("*")]
    # a beginning that stands for one word only is that word
    most: dict[str, int] = {}
    for w in words:
        for k in STEMS:
            most[w[:k] + "*"] = max(most.get(w[:k] + "*", 0), docs_of[w])
    model = Model(words, [w[:-1] for w in docs_of if w.endswith("*") and most.get(w, 0) <= 0.8 * docs_of[w]])
    got = np.array([list(r["x"]) + [r["y"]] for r in _features(rows, model, ["y"]).select("x", "y").collect()])  # at most max_rows rows and repeated ids
    model.weights = _logistic(got[:, :-1], got[:, -1]) if len(got) else model.weights
    return model


def _features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``x`` of each row of ``rows`` (``text`` and these columns)."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(tuple(model.terms), tuple(model.stems))
        for batch in batches:
            x = [features(matcher, t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and the ``matches`` behind it, per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    *w, bias = model.weights
    z = F.lit(bias)
    for i, v in enumerate(w):
        z = z + F.col("x")[i] * F.lit(float(v))
    return (_features(rows, model, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-z)))
            .select("doc_id", "score", F.col("x").alias("matches")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``. The text stays with
    its row: scores are joined by id only where a row is to go."""
    model = learn(docs, labels, id_col, text_col)
    width = len(docs.columns)
    at, more = text_place(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(tuple(model.terms), tuple(model.stems))
        for batch in batches:
            x = np.array([features(matcher, t.as_py() or "") for t in batch.column(at)]).reshape(-1, FEATURES)
            keep = pa.array(model.score(x) < threshold, pa.bool_())
            yield batch.select(range(width)).filter(keep)

    return docs.select(*docs.columns, *more).mapInArrow(run, docs.schema)
