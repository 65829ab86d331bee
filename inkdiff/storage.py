"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read again from spark.checkpoint.dir, which driver and executors share.

    Only a local session may leave it unset; Spark removes the files with the table if its cleaner is set to.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not where and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="inkdiff-kept-"))
    return df.checkpoint()
