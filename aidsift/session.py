"""Session helpers: a local builder for tests and the bench, the
checkpoint folder contract, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "aidsift", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a local session. Cluster jobs get their session from
    the launcher instead; nothing here is needed there."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("AIDSIFT_DRIVER_MEM", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared folder and we only read it.
    Only when it is unset in local mode (tests, bench), where driver and tasks
    share their disk, do we create a scratch folder; elsewhere that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="aidsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a
    local checkpoint: an executor loss must not lose the data)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def sized_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows
    and ``max_bytes`` of values.

    The check reads at most ``max_rows + 1`` rows (``limit``), so it stops
    early on big inputs. Beyond a bound the frame is returned unchanged
    and the planner falls back to a shuffled (sort-merge) join.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) if df.columns else F.lit(0)
    held = df.limit(max_rows + 1).select(size.alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).first()
    return F.broadcast(df) if held["rows"] <= max_rows and (held["bytes"] or 0) <= max_bytes else df
