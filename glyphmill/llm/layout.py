"""How many parts a table is dealt into, and where jobs keep what they write."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def pieces(df: DataFrame, bytes_each: int) -> int:
    """Parts of about ``bytes_each`` for the planner's estimate of ``df``; follows the input, with no cap.

    Where the planner knows no size, the session's number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 58:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, -(-size // bytes_each))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one below /tmp in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file:///tmp/glyphmill-{context.applicationId}"
        spark.conf.set("spark.checkpoint.dir", named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends, and lost executors cost no rows.

    Shuffle files that no frame needs any more go when the driver collects its garbage, so it does that here.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and that table's path."""
    path = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of :func:`stored` that all later steps have read and written on."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: packed, cut off from its lineage, and of a size that the planner knows, which decides its joins."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
