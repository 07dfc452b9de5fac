"""Cutting the lineage of iterative plans, and the folder that this needs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master, whose executors are the driver's own threads, gets a
    temporary one if none is named; a cluster without one is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, which outlives lost executors.

    Set spark.cleaner.referenceTracking.cleanCheckpoints to have Spark delete
    it once the frame is out of use.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
