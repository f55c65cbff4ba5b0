"""Checkpoints in the folder that the session names, so that lineage is cut and lost executors lose nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast: some tens of megabytes of keys and names.
SMALL = 300_000


def durable(df: DataFrame) -> DataFrame:
    """df, checkpointed; sets a folder only where the session has none, as in tests."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tatterloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def partitioned(df: DataFrame, by: str) -> DataFrame:
    """df, written once in a folder per value of a column beside the checkpoints, so that one value is read by itself."""
    spark = durable(df.limit(0)).sparkSession  # sets the folder
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/{by}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
