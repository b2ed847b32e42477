"""Streaming rule engine and file round trips."""

import os
import uuid

from pyspark.sql import functions as F

from aidsift.operators import rules as R
from aidsift.session import ensure_checkpoint_dir
from aidsift.sources import files as IO
from aidsift.streaming import rules_stream as RS

from .conftest import SF_SMALL

KW = [("Of the", "CF"), ("erst", "PAF"), ("only", "AA")]


def test_stream_equals_batch(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{root}/in")
    s = RS.classify_stream(spark, f"{root}/in", docs.schema, ["text"], KW)
    q = RS.start(s.select("doc_id", "`Crisis finance determination`", "`PAF determination`"),
                 f"{root}/out", f"{root}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{root}/out")
    b = docs
    for c in ("humanitarian", "Crisis finance identified", "Crisis finance eligible",
              "Crisis finance predicted ML", "PAF predicted ML", "AA predicted ML"):
        b = b.withColumn(c, F.lit(False))
    want = R.rule_engine(b, ["text"], KW).select("doc_id", "`Crisis finance determination`", "`PAF determination`")
    assert got.count() == want.count() == docs.count()
    assert got.exceptAll(want).count() == 0


def test_sheets_years_roundtrip(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"io-{uuid.uuid4().hex}")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    IO.write_years(o, f"{root}/years")
    back = IO.read_years(spark, f"{root}/years", [1996, 1997])
    assert back.count() == o.where(F.col("year").isin(1996, 1997)).count()
    df = spark.createDataFrame([("a", ".."), ("", "x"), ("#N/A", "y")], "a string, b string")
    got = [tuple(r) for r in IO.null_tokens(df, ["", "#N/A", ".."]).collect()]
    assert got == [("a", None), (None, "x"), (None, "y")]
