"""Cutting lineage through reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in a local session (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortry-"))
        current = sc.getCheckpointDir()
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors.

    A frame settled before is returned as it is.
    """
    if getattr(df, "_settled", False):
        return df
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._settled = True
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder in columns and read back: for large frames, a fraction of a checkpoint's disk."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = True
    return out
