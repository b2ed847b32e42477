"""File sources and sinks (SRC1-SRC9).

Workbook sheets become one Parquet directory per sheet, named datasets
become Parquet partitioned by ``split``, yearly files a ``year`` partition
column (so a year filter prunes directories). Output paths should sit in
shared storage (e.g. under the folder in ``spark.checkpoint.dir``), never
a machine-local temporary folder.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC1: header CSV with quoted multi-line fields and an explicit schema, a file to a task;
    ``csv_records.read_csv_splits`` reads large files with all cores."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def null_tokens(df: DataFrame, tokens: Sequence[str] = ("", "#N/A", ".."),
                cols: Sequence[str] | None = None) -> DataFrame:
    """SRC2: map a set of NA tokens to NULL in string columns (the CSV
    reader takes one ``nullValue`` only)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(list(tokens)), F.col(c)) for c in cols})


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SRC6."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_sheets(sheets: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """SRC7: one Parquet directory per sheet (sheets differ in columns)."""
    for name, df in sheets.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def read_sheet(spark: SparkSession, root: str, sheet: str) -> DataFrame:
    """SRC3."""
    return spark.read.parquet(f"{root.rstrip('/')}/{sheet}")


def write_splits(df: DataFrame, root: str, split: str = "split", mode: str = "overwrite") -> None:
    """SRC8: a dataset with splits, partitioned by split."""
    df.write.mode(mode).partitionBy(split).parquet(root)


def read_split(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """SRC4: the whole dataset or one split (partition pruning)."""
    df = spark.read.parquet(root)
    return df.where(F.col("split") == split) if split else df


def write_years(df: DataFrame, root: str, year: str = "year", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(year).parquet(root)


def read_years(spark: SparkSession, root: str, years: Sequence[int]) -> DataFrame:
    """SRC5: several years of a year-partitioned table (pruned by the filter)."""
    return spark.read.parquet(root).where(F.col("year").isin(list(years)))


def save_model(model: PipelineModel, path: str) -> None:
    """SRC9: a fitted pipeline; one-hot levels and feature layout travel
    inside its stages."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
