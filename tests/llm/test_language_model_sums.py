"""The language model's scores are log probabilities of whole texts."""

import itertools
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aidsift.llm import suffix_tree_lm as LM
from aidsift.session import ensure_checkpoint_dir


@pytest.mark.parametrize("unigram", [0.0, 0.5, 1.0])
def test_probabilities_of_all_texts_sum_to_at_most_one(spark, unigram):
    """All texts of up to four tokens over words of a and b of up to three letters, after training on few and on none."""
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
    texts = [" ".join(t) for n in range(4) for t in itertools.product(words if n < 3 else words[:6], repeat=n)]
    train = ["a ab a", "ab ab", "a", "b aab", ""] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(100_000 + i, t) for i, t in enumerate(train)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = LM.score(docs, F.col("doc_id") >= 100_000, unigram=unigram).where("doc_id < 100000").collect()
    assert len(got) == len(texts) and all(r["score"] < 0 for r in got)
    total = sum(10 ** r["score"] for r in got)
    assert 0.1 < total <= 1
    none = LM.score(docs.where("doc_id < 100000"), F.lit(False), unigram=unigram).collect()
    assert sum(10 ** r["score"] for r in none) <= 1


def test_very_long_unseen_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "x" * 100_000), (3, "b"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in LM.score(docs, F.col("doc_id") == 1).collect()}
    assert all(math.isfinite(r["score"]) for r in got.values()) and got[2]["score"] < -100_000 < got[3]["score"]


def test_runs_and_scores_are_sent_in_few_bytes(spark):
    """What is written for texts of 10 MB with many words and runs stays below 1.2 bytes for each of theirs."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3_000)])
    rows = [(i, " ".join(words[(rng.random(500) ** 8 * len(words)).astype(int)])) for i in range(3_000)]
    size = sum(len(t) for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    place = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {f for f in place.rglob("*.parquet") if f.is_file()}
    got = LM.score(docs, F.col("doc_id") % 7 != 2).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)
    assert sum(f.stat().st_size for f in place.rglob("*.parquet") if f.is_file() and f not in before) < 1.2 * size


def test_scores_come_back_in_order():
    """Scores of runs, coded as one for each state and last byte, are those of each run again."""
    data, begin = np.frombuffer(b"\nabra cad abra\n\nabba cab\n\n\n", dtype=np.uint8), np.array([0, 15, 25, 27])
    turned = np.unique(LM.turned_grams(data, begin))
    before = [bytes(data[max(lo, i - LM.DEPTH):i + 1])[::-1].ljust(8, b"\0") for lo, hi in itertools.pairwise(begin.tolist()) for i in range(lo + 1, hi)]
    assert turned.tolist() == sorted({int.from_bytes(x, "big") for x in before})
    depth = np.array([sum(c > 0 for c in int(x).to_bytes(8, "big")[1:1 + i % 4]) for i, x in enumerate(turned)], dtype=np.uint8)
    each = np.array([hash((int(x) >> 8 * (LM.DEPTH - int(d)), int(d))) % 1000 for x, d in zip(turned, depth)], dtype=np.float32)
    coded = [pa.py_buffer(x) for x in LM._scores_coded(turned, each, depth)]
    assert LM._scores_decoded(turned, *coded).tolist() == each.tolist()
