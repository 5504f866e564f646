"""Comparing two tables by key, and validating catalog records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed states of a dataset record.
STATUSES = ("ready", "processing", "error")


def reconcile(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key…, left_count, right_count, finding)`` for every key the tables disagree on.

    ``missing``: only on the left; ``orphaned``: only on the right; ``mismatch``: different
    row counts.  Both sides are counted per key before they meet, so a key held by a third
    of the rows is one record, and one outer join answers all three.  NULL keys compare equal.
    """
    keys = list(key)
    other = [f"_right_{i}" for i in range(len(keys))]
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_count"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_count")).toDF(*other, "right_count")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other)])
    finding = (
        F.when(F.col("right_count") == 0, "missing")
        .when(F.col("left_count") == 0, "orphaned")
        .when(F.col("left_count") != F.col("right_count"), "mismatch")
    )
    return (
        a.join(b, same, "full_outer")
        .select(
            *[F.coalesce(F.col(k), F.col(o)).alias(k) for k, o in zip(keys, other)],
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_count", "right_count")],
        )
        .withColumn("finding", finding)
        .where(F.col("finding").isNotNull())
    )


def reconcile_summary(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return reconcile(left, right, key).groupBy("finding").agg(F.count(F.lit(1)).alias("keys"))


def validate(
    df: DataFrame, key: str, predicates: Mapping[tuple[str, str, str], Column]
) -> DataFrame:
    """``(key, type, severity, detail)``: one row per record and violated rule.

    ``predicates`` maps ``(type, severity, detail)`` to the condition under which it is violated.
    """
    hits = F.array(
        *[
            F.when(
                F.coalesce(cond, F.lit(False)),
                F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(d).alias("detail")),
            )
            for (t, s, d), cond in predicates.items()
        ]
    )
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(hits)).alias("f")).select("key", "f.*")


def validate_datasets(catalog: DataFrame) -> DataFrame:
    """Rules for catalog records: required fields, known status, and what a ready record must have.

    Expects ``id, path, status, sample_rows, row_count, column_count``.
    """

    def absent(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c).cast("string") == "")

    ready = F.col("status") == "ready"
    no_summary = F.col("row_count").isNull() & F.col("column_count").isNull()
    return validate(
        catalog,
        "id",
        {
            ("missing_property", "high", "id"): absent("id"),
            ("missing_property", "high", "path"): absent("path"),
            ("missing_property", "medium", "status"): absent("status"),
            ("invalid_status", "medium", "status"): ~absent("status") & ~F.col("status").isin(*STATUSES),
            ("missing_sample", "high", "sample"): ready & F.col("sample_rows").isNull(),
            ("empty_sample", "high", "sample"): ready & (F.col("sample_rows") == 0),
            ("missing_summary", "medium", "summary"): ready & no_summary,
            ("invalid_summary", "medium", "columns"): ready & ~no_summary & F.col("column_count").isNull(),
            ("invalid_summary", "medium", "row_count"): ready & ~no_summary & F.col("row_count").isNull(),
        },
    )


def union_findings(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of several checks in one table, each tagged with its category."""
    tagged = [f.withColumn("category", F.lit(name)) for name, f in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def new_rows(candidates: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose key is not among the existing rows; NULL keys compare equal."""
    marked = existing.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return candidates.join(marked, same, "left_anti")
