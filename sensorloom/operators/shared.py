"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder of a session without one: ``spark.checkpoint.dir``, or a temporary folder for a local master; any other master is an error, as its executors share no local folder."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="sensorloom-")
    spark.sparkContext.setCheckpointDir(base)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as files of the checkpoint folder, which can be read many times."""
    use_checkpoints(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
