"""Where plans that iterate cut their lineage, the folder that the cluster shares; and how tables of records are joined."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: shuffled and sorted, never broadcast.

    Spark's estimate of rows made by ``explode`` is that of the rows they come from, in compressed files: far too small.
    """
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint in ``spark.checkpoint.dir``.

    Only a session in one process gets a local folder where that is unset; a cluster must name one that it shares.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint()
