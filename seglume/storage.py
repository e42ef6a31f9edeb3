"""Intermediate tables in the folder that driver and executors share.

``stage`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back: lineage ends there, the
rows survive the loss of executors, and later readers still get column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only in local mode (tests) where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seglume-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_file(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/seglume/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_file(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
