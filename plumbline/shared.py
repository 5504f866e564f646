"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, as configured or set on the context.

    Only a single-process ``local`` session, as in tests, may run without it; it gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}/{name}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or dealt out to all cores where its scan has fewer partitions than there are cores.

    For costly expressions over small files, whose row groups are not split.  Tables of many
    files, and results of shuffles, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # asking a plan with shuffles for its partitions would run them
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.monotonically_increasing_id())
