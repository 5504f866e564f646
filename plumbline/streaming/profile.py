"""Column summary and sample kept up to date over a stream, in a versioned table.

Every micro-batch is reduced to a partial state: counts, sum, min and max, a sketch of
distinct values and one of quantiles, a row per column, which is merged with the version
that the batch before left (``versions.keep_state``).  A restart goes on from the checkpoint
and the last version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.columns import Cell, cells, long
from plumbline.operators.ordering import doubles_sql
from plumbline.operators.sampling import merge_reservoirs, seeded_hash, tie_columns
from plumbline.operators.summary import finish_summary
from plumbline.shared import shared_dir
from plumbline.streaming.versions import keep_state, latest_state

QUANTILE_K = 800
DISTINCT_LG_K = 12
COUNTS = ("count", "null_count", "numeric_count", "text_count")


def _facts(c: Cell):
    num = c.number("strict")
    return F.struct(
        F.lit(c.ordinal).alias("ordinal"), num.alias("num"), F.coalesce(~c.missing, F.lit(False)).alias("present"), c.text().alias("text")
    )


def _counted(rows: DataFrame, columns: Iterable[str] | None):
    f = long(rows, cells(rows, columns), _facts).select("column", "value.*")
    aggregates = [
        F.count_if("present").alias("count"),
        F.count_if(~F.col("present")).alias("null_count"),
        F.count("num").alias("numeric_count"),
        F.count_if(F.col("present") & F.col("num").isNull()).alias("text_count"),
        F.coalesce(F.sum("num"), F.lit(0.0)).alias("sum"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
    ]
    return f.groupBy("column", "ordinal"), aggregates


def profile_stream(stream: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Streaming ``column_summary``: write it in ``complete`` or ``update`` mode.

    Works on a batch table too, with the same result.
    """
    grouped, aggregates = _counted(stream, columns)
    return finish_summary(grouped.agg(*aggregates))


def partial_state(rows: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The mergeable state of a batch: a row per column."""
    grouped, aggregates = _counted(rows, columns)
    text = F.when(F.col("present"), F.col("text"))
    quantiles = F.call_function("kll_sketch_agg_double", F.col("num"), F.lit(QUANTILE_K))
    return grouped.agg(*aggregates, F.hll_sketch_agg(text, F.lit(DISTINCT_LG_K)).alias("distinct"), quantiles.alias("quantiles"))


def merge_states(states: DataFrame) -> DataFrame:
    """One state of several: rows of the same column put together."""
    merged = F.call_function("kll_merge_agg_double", F.col("quantiles"), F.lit(QUANTILE_K))
    return states.groupBy("column", "ordinal").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        merged.alias("quantiles"),
    )


def summary_of(state: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``column_summary`` of a state, with estimates ``distinct_values`` and ``approximate_quantiles`` at the shares."""
    quantiles = F.call_function("kll_sketch_get_quantile_double", F.col("quantiles"), F.expr(doubles_sql(shares)))
    estimates = state.withColumn("distinct_values", F.hll_sketch_estimate("distinct")).withColumn(
        "approximate_quantiles", F.when(F.col("numeric_count") > 0, quantiles)
    )
    return finish_summary(estimates.drop("distinct", "quantiles"))


def keep_profile(stream: DataFrame, path: str, columns: Iterable[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query that keeps the summary's state below ``path``; see ``versions.keep_state``."""
    picked = list(columns) if columns is not None else None
    return keep_state(stream, path, lambda batch: partial_state(batch, picked), merge_states, trigger)


def keep_reservoir(
    stream: DataFrame, path: str, k: int, key: Sequence[str] | None = None, seed: int | str = 0, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the query that keeps ``k`` rows of the stream, the same as ``reservoir_sample`` takes of all its rows.

    ``latest_state(spark, path).drop("_h")`` is the sample so far.
    """

    def partial(batch: DataFrame) -> DataFrame:
        return merge_reservoirs(batch.withColumn("_h", seeded_hash(batch, key, seed)), k, tie_columns(batch, key))

    return keep_state(stream, path, partial, lambda rows: merge_reservoirs(rows, k, tie_columns(rows.drop("_h"), key)), trigger)


def checkpoint_root(spark: SparkSession) -> str:
    """A new folder in the one that the session shares."""
    return f"{shared_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"


def run_profile(
    stream: DataFrame, name: str, checkpoint: str | None = None, columns: Iterable[str] | None = None
) -> DataFrame:
    """Takes in everything the source has now and returns the summary so far, also as view ``name``.

    The result has one row per column.  Give ``checkpoint``, a shared folder, to continue an
    earlier run.
    """
    spark = stream.sparkSession
    path = checkpoint or checkpoint_root(spark)
    keep_profile(stream, path, columns).awaitTermination()
    out = summary_of(latest_state(spark, path)).drop("distinct_values", "approximate_quantiles")
    out.createOrReplaceTempView(name)
    return out
