"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is not set, the session's checkpoint folder is taken; a local session without one, as in tests,
    gets a folder of its own. On a cluster a machine's own folder would be seen by that machine only: an error.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        found = context._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing. codec: Spark's own if not given."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
