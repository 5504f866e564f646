"""Exact-size samples that are the same on every run and every partitioning.

Rows are ordered by a seeded hash of their key and the smallest are taken.  The hashes are
counted by their first digits; the counts say at which digits the sample ends, and only the
rows with just those digits are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import cells
from plumbline.operators.frequency import cardinality
from plumbline.shared import cut


# Tasks' reservoirs are merged in so many groups, for samples of up to so many rows.
MERGES = 64
RESERVOIR_ROWS = 1_000_000
# Strata whose quotas are broadcast.
BROADCAST_STRATA = 200_000


def seeded_hash(df: DataFrame, key: Sequence[str] | None, seed: int | str) -> Column:
    parts = [F.coalesce(c.text(), F.lit("")) for c in cells(df, key or None)]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def tie_columns(df: DataFrame, key: Sequence[str] | None) -> list[Column]:
    return [c.raw for c in cells(df, key or None) if c.dtype.typeName() not in ("map", "variant")]


def _head(n: int) -> Column:
    """So many first digits of the hash that there are about as many heads as rows of one head."""
    return F.substring("_h", 1, max(1, min(8, math.ceil(math.log(max(n, 2), 16) / 2))))


def _smallest(hashed: DataFrame, k: int, ties: Sequence[Column]) -> DataFrame:
    """The ``k`` rows of the smallest ``_h``."""
    n = hashed.count()
    if n <= k:
        return hashed
    head = _head(n)
    sizes = hashed.groupBy(head.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # a row per head, at most about the root of the rows
    run = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    end = run.where((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k)).first()
    if end is None:  # k is 0
        return hashed.limit(0)
    last = hashed.where(head == end["_p"]).orderBy("_h", *ties).limit(k - end["_before"])
    return hashed.where(head < end["_p"]).unionByName(last)


def random_sample(
    df: DataFrame, k: int, key: Sequence[str] | None = None, seed: int | str = 0
) -> DataFrame:
    """Exactly ``min(k, n)`` rows, without replacement.  ``key`` should identify a row."""
    return _smallest(df.withColumn("_h", seeded_hash(df, key, seed)), k, tie_columns(df, key)).drop("_h")


def reservoir_sample(df: DataFrame, k: int, key: Sequence[str] | None = None, seed: int | str = 0) -> DataFrame:
    """The rows of ``random_sample`` out of one scan: every ``k``-subset is equally likely.

    Every task holds the ``k`` rows of smallest hash that it has seen; tasks' reservoirs are
    merged in ``MERGES`` groups, and these into one.  That passes ``k`` rows through a task,
    so a sample above ``RESERVOIR_ROWS`` is left to ``random_sample``.
    """
    if k > RESERVOIR_ROWS:
        return random_sample(df, k, key, seed)
    return merge_reservoirs(df.withColumn("_h", seeded_hash(df, key, seed)), k, tie_columns(df, key)).drop("_h")


def merge_reservoirs(rows: DataFrame, k: int, ties: Sequence[Column] = ()) -> DataFrame:
    """The ``k`` rows with the smallest ``_h``, of one or several reservoirs put together."""
    group = F.pmod(F.spark_partition_id(), F.lit(MERGES))
    # the limit on the rank is applied in every task before its rows are shuffled
    first = F.row_number().over(Window.partitionBy("_merge").orderBy("_h", *ties))
    merged = rows.withColumn("_merge", group).withColumn("_rank", first).where(F.col("_rank") <= k)
    return merged.drop("_merge", "_rank").orderBy("_h", *ties).limit(k)


def stratified_sample(
    df: DataFrame, stratum: str, k: int, key: Sequence[str] | None = None, seed: int | str = 0
) -> DataFrame:
    """Per stratum ``max(1, round(k * share))`` rows, then cut to ``k`` by a hash of its own,
    so that the final cut falls on all strata alike.

    Within a stratum the hashes are counted by their first digits, as for the whole, and only
    the rows where its quota ends are ordered, so a stratum of any size is many tasks' work.
    """
    total = df.count()
    if total <= k:
        return df
    label = F.coalesce(cells(df, [stratum])[0].text(), F.lit(""))
    ties, head = tie_columns(df, key), _head(total)
    hashed = df.withColumn("_h", seeded_hash(df, key, seed)).withColumn("_s", label)
    sizes = hashed.groupBy("_s", head.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    size = F.sum("_n").over(Window.partitionBy("_s"))
    quota = F.greatest(F.lit(1), F.floor(size * F.lit(float(k)) / F.lit(float(total)) + 0.5))
    run = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("_n")
    ends = (
        sizes.select("_s", "_p", "_n", quota.alias("_quota"), run.alias("_before"))
        .where((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota")))
        .select("_s", F.col("_p").alias("_end"), (F.col("_quota") - F.col("_before")).alias("_left"))
    )
    ends = cut(ends)
    # a row per stratum: sent to all tasks where that is little, so that a large stratum stays where it is
    rows = hashed.join(F.broadcast(ends) if ends.count() <= BROADCAST_STRATA else ends, "_s")
    first = F.row_number().over(Window.partitionBy("_s").orderBy("_h", *ties))
    last = rows.where(head == F.col("_end")).withColumn("_r", first).where(F.col("_r") <= F.col("_left")).drop("_r")
    kept = rows.where(head < F.col("_end")).unionByName(last)
    trim = F.md5(F.concat("_h", F.lit("trim")))
    return _smallest(kept.withColumn("_h", trim), k, ties).drop("_h", "_s", "_end", "_left")


def adaptive_sample(
    df: DataFrame, types: Mapping[str, str], k: int, key: Sequence[str] | None = None, seed: int | str = 0
) -> DataFrame:
    """Stratified on the categorical column with most values when there is one, else uniform."""
    categorical = [c for c, t in types.items() if t == "categorical"]
    if not categorical:
        return random_sample(df, k, key, seed)
    order = {c: i for i, c in enumerate(categorical)}
    rows = cardinality(df, categorical).collect()  # one row per column
    widest = min(rows, key=lambda r: (-r["cardinality"], order[r["column"]]))["column"]
    return stratified_sample(df, widest, k, key, seed)
