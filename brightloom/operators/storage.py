"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Computed once into the folder of spark.checkpoint.dir; where that is unset, a temporary folder if all runs on one machine, else an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="brightloom-"))
    return df.checkpoint(eager=True)
