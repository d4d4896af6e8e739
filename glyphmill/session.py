"""What a session needs to run the package's Python workers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; on a cluster that shares no such path, ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Whole texts can be long: batches for Python workers are bounded by bytes, unless the session already sets another bound than the default.
    if spark.conf.get(_BYTES) in ("67108864b", "64m"):
        spark.conf.set(_BYTES, "8m")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that spark.checkpoint.dir names, so that a loop's plan doesn't grow; in local mode without that setting, below /tmp."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or f"file:///tmp/glyphmill-{context.applicationId}")
    return df.checkpoint(eager=True)
