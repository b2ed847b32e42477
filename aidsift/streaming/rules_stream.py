"""The rule engine (E1) on a stream.

Every rule step is a per-row column expression, so the same plan runs on a
``readStream`` source unchanged: no state, no watermark. Files landing in
``source_dir`` are classified and appended to ``sink_dir`` (Parquet), with
progress in ``checkpoint`` so a restarted or re-scheduled query resumes
exactly once.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import rules as R


def classify_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                    text_cols: Sequence[str], keywords: Sequence[tuple[str, str]],
                    punct: str = "word", variant: str = "r", max_files: int = 100) -> DataFrame:
    """Streaming DataFrame of determinations over Parquet files arriving in
    ``source_dir``. Model columns (``<label> predicted ML``) and code flags
    must already be in the input; missing flags default to false."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    for c in ("humanitarian", "Crisis finance identified", "Crisis finance eligible",
              "Crisis finance predicted ML", "PAF predicted ML", "AA predicted ML"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(False))
    return R.rule_engine(s, text_cols, keywords, punct=punct, variant=variant)


def start(df: DataFrame, sink_dir: str, checkpoint: str, trigger_seconds: int | None = None) -> StreamingQuery:
    """Append to Parquet with a checkpoint in shared storage."""
    w = df.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)
    return w.start()
