"""Written intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from wardline.session import materialise


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df``, read it back, and let go of the shuffle files that made it.

    Spark deletes shuffle files when the driver collects the plan they belong
    to.  Asking for that between phases keeps the disk need at that of one phase.
    """
    written = materialise(df, name)
    del df
    gc.collect()
    written.sparkSession.sparkContext._jvm.System.gc()
    return written
