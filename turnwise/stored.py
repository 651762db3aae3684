"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, read by later plans without being made again.

    It lies in the folder that ``spark.checkpoint.dir`` names; one is made only where
    none is set and driver and executors are one process.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="turnwise-"))
    return df.checkpoint()
