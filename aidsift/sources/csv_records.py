"""Multi-line CSV that splits (SRC1).

A line break inside quotes does not end a record, so a split of a file cannot
tell where its first record begins; that is why the multi-line reader takes a file in
one task. Whether a split begins inside quotes follows from the number of quotes
before it: a first pass counts them per split, their running parity tells each
split its state, and a second pass puts lines together into records, in every split at
once. What reaches over a split's end is stitched from the few pieces that
splits begin and end with. Quotes inside fields are doubled, as pandas and R
write them, which keeps the parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE, CLOSES, INSIDE, OPENS = range(4)
_SCHEMA = "file string, block long, place long, part int, value string"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("value", pa.string())])
BATCH_BYTES = 1 << 22


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order, with their quotes and whether their split begins inside quotes, to records and the splits' end pieces."""
    at, held, inside, first, place, out, size = None, [], False, False, 0, [], 0

    def flush():
        nonlocal held
        if at is not None and held:
            out.append((*at, place, INSIDE if first and inside else OPENS, "\n".join(held)))
        held = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for batch in batches:
        value, file, block, quotes, begun = (batch.column(i).to_pylist() for i in range(5))
        for i in range(len(value)):
            here = (file[i], block[i])
            if here != at:
                flush()
                at, inside, first, place = here, begun[i], begun[i], 0
            held.append(value[i])
            size += len(value[i])
            inside ^= quotes[i] % 2 == 1
            if not inside:
                out.append((*at, place, CLOSES if first else WHOLE, "\n".join(held)))
                held, first, place = [], False, place + 1
        if size > BATCH_BYTES and out:
            yield batch_of(out)
            out, size = [], 0
    flush()
    if out:
        yield batch_of(out)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, value``: the records of CSV files as text, the header left in; a record is placed where it begins."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("begun"))
    # a row per split, which is at least a block of a file; the lookup keeps the lines in their order
    marked = lines.join(F.broadcast(splits), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("value", "file", "block", "quotes", "begun")
    pieces = marked.mapInArrow(_records, _SCHEMA)
    ends = pieces.where(F.col("part") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "place")
    opened = F.when(F.col("part") == OPENS, F.struct("block", "place"))
    ends = ends.withColumn("begin", F.last(opened, ignorenulls=True).over(order))
    stitched = ends.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("p"))
    stitched = stitched.select("file", F.col("begin.block").alias("block"), F.col("begin.place").alias("place"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return pieces.where(F.col("part") == WHOLE).select("file", "block", "place", "value").unionByName(stitched)


def read_csv_splits(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC1 for files of any size: header CSV with quoted multi-line fields, read by all cores. Rows come in no order; empty records are skipped."""
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    records = csv_records(spark, path).where((F.col("block") != 0) | (F.col("place") != 0))
    records = records.select(F.regexp_replace("value", "\r$", "").alias("value")).where("value != ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0001"}
    return records.select(F.from_csv("value", kind, options).alias("r")).select("r.*")
