"""Frames that are read more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: cuts lineage and survives lost executors, and its rows keep their places.

    The folder is the session's spark.checkpoint.dir; only a local session without one gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="deltaplane-")
        context.setCheckpointDir(root)
    return df.checkpoint()
