"""Cutting lineage between rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names; a local session without one takes a new folder
    of its own, a cluster must have one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            folder = tempfile.mkdtemp(prefix="cueframe-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
