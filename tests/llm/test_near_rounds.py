"""Near-duplicates: the exact filter of whole sketches, and rounds over long lists."""

from __future__ import annotations

import random

import numpy as np

from aidsift.llm import minhash


def sketch(values):
    return np.array(sorted(values), dtype=np.uint32)


def test_sketches_of_whole_sets_filter_exactly():
    base = list(range(1, 101))
    x = [sketch(base)]
    y = [sketch([*base[:86], *range(500, 514)]), sketch([*base[:85], *range(500, 515)])]  # 86 of 114, 85 of 115
    got = minhash._passes(x, y, np.array([100]), np.array([100, 100]))
    assert got[0, 0] > 0 and got[0, 1] == 0
    # a value that 32 bits took for another one may have been shared
    assert minhash._passes(x, [sketch([*base[:86], *range(500, 513)])], np.array([101]), np.array([100]))[0, 0] > 0


def test_sketches_of_large_sets_are_estimated():
    n = 4 * minhash.FULL
    f = [sketch(range(0, 4 * minhash.FULL, 4))]
    assert minhash._passes(f, f, np.array([n]), np.array([n]))[0, 0] > 0


def test_near_copies_below_the_threshold_take_no_rounds(spark, monkeypatch):
    """Texts that share a hot line and most of their words, but not enough: none is proposed again and again."""
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BEST", 1)
    writes, write = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: (writes.append(name), write(df, name))[1])
    line = [f"w{i}" for i in range(64)]  # 60 shingles
    r = random.Random(5)
    rows = [(i, " ".join([*line, *(f"x{i}y{r.randrange(99)}" for _ in range(9))])) for i in range(30)]  # 60 of 78 is linked
    rows += [(100 + i, " ".join([*line, *(f"x{i}z{r.randrange(99)}" for _ in range(11))])) for i in range(30)]  # 60 of 82 is not, of 80 it is
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row["doc_id"]: row["component_id"] for row in minhash.near_duplicates(frame).collect()}
    assert got == {i: 0 for i, _ in rows}
    assert writes.count("lists") <= 2
    writes.clear()
    apart = [(i, " ".join([*line, *(f"x{i}z{k}" for k in range(11))])) for i in range(30)]
    got = {row["doc_id"]: row["component_id"] for row in minhash.near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in apart}
    assert writes.count("lists") <= 1
