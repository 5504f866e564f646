"""Value frequencies: top values with the rest folded together, cardinality, counts by category.

Everything starts from ``value_counts``, one row per distinct value of each column, whose
shuffle carries map-side counts; a value held by a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import Cell, cells, long, number_cells, wide

OTHER = "Other"
TOP_VALUES = 20


def text_cells(df: DataFrame, columns: Iterable[str] | None) -> list[Cell]:
    picked = cells(df, columns)
    return picked if columns is not None else [c for c in picked if c.is_text]


def value_counts(
    df: DataFrame, columns: Iterable[str] | None = None, empty_is_value: bool = False
) -> DataFrame:
    """``(column, value, count)``; values as text, missing cells dropped."""
    rows = long(df, text_cells(df, columns), lambda c: c.text())
    present = F.col("value").isNotNull()
    if not empty_is_value:
        present = present & (F.col("value") != "")
    return rows.where(present).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values of one column."""
    cell = cells(df, [column])[0]
    return df.where(~cell.missing).select(cell.raw.alias("value")).distinct()


def frequency(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    top: int = TOP_VALUES,
    empty_is_value: bool = True,
    other: str = OTHER,
) -> DataFrame:
    """``(column, value, count, rank, column_count, unique_count)``: most frequent values, rest as ``other``.

    Ties go to the smaller value.  The rank filter lets every task drop all but its own
    ``top`` rows before they are shuffled.
    """
    return fold_tail(value_counts(df, columns, empty_is_value), top, other)


def fold_tail(counts: DataFrame, top: int, other: str) -> DataFrame:
    by_count = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    head = counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= top)
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("column_count"), F.count(F.lit(1)).alias("unique_count")
    )
    # the rest of a column follows its last shown value; these windows see `top` rows per column
    shown = Window.partitionBy("column")
    rest = F.col("column_count") - F.col("shown")
    itself = F.struct("value", "count", "rank")
    tail = F.struct(F.lit(other).alias("value"), rest.alias("count"), F.lit(top + 1).alias("rank"))
    return (
        head.withColumn("shown", F.sum("count").over(shown))
        .withColumn("last", F.max("rank").over(shown))
        .join(F.broadcast(totals), "column")  # one row per column
        .select(
            "column",
            F.inline(
                F.when((F.col("rank") == F.col("last")) & (rest > 0), F.array(itself, tail)).otherwise(F.array(itself))
            ),
            "column_count",
            "unique_count",
        )
    )


def categorical_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: valid, missing, unique counts, most and least frequent value with shares."""
    picked = text_cells(df, columns)
    present = wide(
        df,
        picked,
        lambda c: {"count": F.count(F.lit(1)), "missing": F.count_if(c.missing)},
    )
    freq = value_counts(df, [c.name for c in picked])
    # extremes of (count, value): the most frequent value, ties to the smaller one, and the reverse
    extremes = freq.groupBy("column").agg(
        F.sum("count").alias("valid_count"),
        F.count(F.lit(1)).alias("unique_values"),
        F.min(F.struct((-F.col("count")).alias("neg"), "value")).alias("most"),
        F.max(F.struct((-F.col("count")).alias("neg"), "value")).alias("least"),
    )
    valid = F.col("valid_count").cast("double")
    return present.join(F.broadcast(extremes), "column", "left").select(
        "column",
        "ordinal",
        "count",
        F.coalesce("valid_count", F.lit(0)).alias("valid_count"),
        "missing",
        F.try_divide(F.col("missing") * 100.0, F.col("count").cast("double")).alias("missing_pct"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        F.col("most.value").alias("most_frequent"),
        (-F.col("most.neg")).alias("most_count"),
        F.try_divide(-F.col("most.neg") * 100.0, valid).alias("most_pct"),
        F.col("least.value").alias("least_frequent"),
        (-F.col("least.neg")).alias("least_count"),
        F.try_divide(-F.col("least.neg") * 100.0, valid).alias("least_pct"),
    )


def categorical_value_counts(
    df: DataFrame, columns: Iterable[str] | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """Top values with their share of the valid cells; the rest as ``__other__``."""
    f = frequency(df, columns, top, empty_is_value=False, other="__other__")
    pct = F.try_divide(F.col("count") * 100.0, F.col("column_count").cast("double"))
    return f.select("column", "value", "count", "rank", pct.alias("percentage"))


def cardinality(
    df: DataFrame, columns: Iterable[str] | None = None, approximate: bool = False, rsd: float = 0.02
) -> DataFrame:
    """``(column, cardinality)``: distinct non-null values."""
    picked = text_cells(df, columns)
    if approximate:
        return wide(df, picked, lambda c: {"cardinality": F.approx_count_distinct(c.raw, rsd)}).drop("ordinal")
    counts = long(df, picked, lambda c: c.text()).where(F.col("value").isNotNull())
    found = counts.groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality")
    )
    names = wide(df, picked, lambda c: {"filled": F.count(c.raw)})
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("cardinality", F.lit(0)).alias("cardinality")
    )


def continuity(
    df: DataFrame, columns: Iterable[str] | None = None, min_values: int = 10, share: float = 0.2
) -> DataFrame:
    """``(column, n, distinct, is_continuous)``: enough values, and more than a fifth of them distinct."""
    rows = long(df, number_cells(df, columns), lambda c: c.number()).where(F.col("value").isNotNull())
    per_value = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return per_value.groupBy("column").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("distinct")
    ).withColumn("is_continuous", (F.col("n") >= min_values) & (F.col("distinct") > F.col("n") * F.lit(share)))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """``(category, count)`` of one column, missing values dropped."""
    cell = cells(df, [column])[0]
    return (
        df.where(~cell.missing)
        .groupBy(cell.text().alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
