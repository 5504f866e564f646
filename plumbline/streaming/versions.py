"""A small mergeable state of a stream, kept as a versioned Parquet table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def version_path(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/state/version={batch}"


def keep_state(
    stream: DataFrame,
    path: str,
    partial: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a query that keeps the state of all rows so far below ``path``, a folder that driver and executors share.

    ``partial`` reduces a batch to its state, ``merge`` makes one state of several put
    together.  Each batch writes the next version from the one that the batch before left; a
    batch that is run again after a failure starts from the same version and overwrites its
    own, so nothing counts twice.  By default the query takes in what the source has now and
    ends.
    """

    def step(batch: DataFrame, number: int) -> None:
        state = partial(batch)
        if number > 0:
            # versions follow one another as batches do
            state = merge(state.unionByName(batch.sparkSession.read.parquet(version_path(path, number - 1))))
        state.coalesce(1).write.mode("overwrite").parquet(version_path(path, number))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path.rstrip('/')}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch that was taken in."""
    # a version per batch, each of a bounded number of rows
    every = spark.read.option("basePath", f"{path.rstrip('/')}/state").parquet(f"{path.rstrip('/')}/state/version=*")
    last = every.agg(F.max("version")).first()[0]
    return spark.read.parquet(version_path(path, last))
