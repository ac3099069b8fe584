"""Cutting lineage on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or an earlier ``setCheckpointDir``."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared checkpoint folder, where it survives the loss of executors.

    Without a folder ``df`` itself: what reads it computes it again.
    """
    return df.checkpoint(eager=True) if checkpoint_dir(df.sparkSession) else df


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: the checkpoint folder, or the warehouse where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
