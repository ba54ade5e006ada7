"""Intermediate results in the folder that all executors see."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only on this machine alone (tests) a temporary folder will do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="turnstone-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
