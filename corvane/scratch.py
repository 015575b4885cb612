"""Tables kept between steps of an iteration: checkpoints in the folder that the executors share; how tables are dealt and joined."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only if the setting is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    context = spark.sparkContext
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return large(df.checkpoint(eager=True))


def large(df: DataFrame) -> DataFrame:
    """``df``, never sent whole to all tasks in a join.

    Spark takes tables made by Python, by exploding or by joins on them for as
    large as the small table they come from, and would collect them in the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by a key: a small table may be one task's, whatever is made of its rows."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)
