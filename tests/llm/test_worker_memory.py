"""What tasks hold beside their texts (pipeline, op8_secrets)."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from aidsift.llm import decontaminate, secret_scan, toxicity
from aidsift.llm.wordhash import flat

SCHEMA = "doc_id long, text string, n_chars long"


def test_long_runs_hold_little_beside_the_texts():
    texts = pa.array(["a b " * 1000] * 2000 + ["x" * 20])  # 8 MB
    data, off = flat(texts)
    tracemalloc.start()
    try:
        got = secret_scan.long_runs(data, off)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.flatnonzero(got).tolist() == [2000]
    assert peak < len(data), "bytes beside the texts"


@pytest.mark.parametrize("chunk", [1, 7, 20, 1 << 19])
def test_long_runs_at_any_cut(chunk):
    rows = ["", "a" * 19, " ", "b" * 20, "", " " + "c" * 19 + " ", "d" * 45 + " x", None, " " * 30, "é" + "e" * 20, "f" * 19]
    data, off = flat(pa.array(rows))
    got = secret_scan.long_runs(data, off, chunk=chunk)
    assert got[[3, 6, 9]].all() and not got[[0, 2, 4, 5, 7, 8, 10]].any()  # a text may be named for a run that goes on in the next one
    assert secret_scan.long_runs(data[:0], off[:1], chunk=chunk).tolist() == []
    one, at = flat(pa.array(rows).slice(6, 2))
    assert secret_scan.long_runs(one, at, chunk=chunk).tolist() == [True, False]


def test_stages_send_each_text_once(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} of a text", 5) for i in range(8)] + [(8, "one two three four five six seven eight", 5), (9, None, 5)], SCHEMA)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    clean = decontaminate.without_benchmark(docs, bench)
    calm = toxicity.without_toxic(docs, labels, threshold=1.1)
    for out in (clean, calm):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "as binary" not in plan and "_text" not in plan, plan
    assert {r["doc_id"] for r in clean.collect()} == {*range(8), 9}
    assert calm.count() == 10
    binary = docs.withColumn("text", docs["text"].cast("binary"))
    assert {r["doc_id"] for r in decontaminate.without_benchmark(binary, bench).collect()} == {*range(8), 9}
    assert toxicity.without_toxic(binary, labels, threshold=1.1).count() == 10
