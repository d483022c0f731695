"""Sessions, and the shared folder that iterative plans checkpoint to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or a local one where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        folder = f"file://{tempfile.gettempdir()}/vellum-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
