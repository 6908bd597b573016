"""Cut the lineage of a small, narrow table that several jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder and runs on one machine (tests, a laptop).
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/comarca"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; our own only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or DEFAULT_CHECKPOINT_DIR)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The rows from the checkpoint folder, without their lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
