"""The data behind each chart: one aggregate per chart, small whatever the table's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import clamp_non_negative
from plumbline.operators.columns import cells
from plumbline.operators.correlation import chart_matrix
from plumbline.operators.histogram import histogram
from plumbline.operators.quantiles import boxplot
from plumbline.operators.sampling import random_sample
from plumbline.operators.temporal import time_series

# How many groups, points or rows each chart shows.
BAR_GROUPS = 25
HORIZONTAL_BAR_GROUPS = 30
PIE_LIMIT = 10
PIE_KEPT = 7
TREEMAP_GROUPS = 20
HEATMAP_SIDE = 20
SCATTER_POINTS = 2000
BUBBLE_POINTS = 1000
LINE_POINTS = 1000
TABLE_ROWS = 100
HISTOGRAM_BINS = 20
COUNT = "count"


def _label(df: DataFrame, category: str) -> Column:
    return F.coalesce(cells(df, [category])[0].text(), F.lit(""))


def group_average(df: DataFrame, category: str, value: str) -> DataFrame:
    """``(category, value)``: mean of the parseable values per category.

    With ``value="count"``, and no such column, the number of rows per category.
    """
    label = _label(df, category).alias("category")
    if value == COUNT and COUNT not in df.columns:
        return df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("value"))
    num = cells(df, [value])[0].number()
    return df.where(num.isNotNull()).groupBy(label).agg(F.avg(num).alias("value"))


def top_groups(groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest groups; ties go to the smaller label."""
    return groups.orderBy(F.desc("value"), "category").limit(k)


def bar(df: DataFrame, category: str, value: str, groups: int = BAR_GROUPS) -> DataFrame:
    return top_groups(group_average(df, category, value), groups)


def horizontal_bar(df: DataFrame, category: str, value: str) -> DataFrame:
    return bar(df, category, value, HORIZONTAL_BAR_GROUPS)


def excluded_rows(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row: how many rows of a bar chart lack a category or a readable number."""
    c, v = cells(df, [category, value])
    unread = v.raw.isNotNull() & v.number().isNull()
    bad = F.count_if(c.missing | unread).alias("invalid_rows")
    return df.agg(F.count(F.lit(1)).alias("rows"), bad)


def pie(df: DataFrame, category: str, value: str) -> DataFrame:
    """All groups up to ten, the largest seven beyond that."""
    head = top_groups(group_average(df, category, value), PIE_LIMIT + 1)
    # the windows see at most eleven rows
    everything = Window.partitionBy(F.lit(1))
    ranked = head.withColumn("_n", F.count(F.lit(1)).over(everything)).withColumn(
        "_r", F.row_number().over(everything.orderBy(F.desc("value"), "category"))
    )
    return ranked.where((F.col("_n") <= PIE_LIMIT) | (F.col("_r") <= PIE_KEPT)).select("category", "value")


def treemap(df: DataFrame, category: str, value: str) -> DataFrame:
    """The twenty largest groups, negative means drawn as 0."""
    top = top_groups(group_average(df, category, value), TREEMAP_GROUPS)
    return top.select("category", clamp_non_negative(F.col("value")).alias("value"))


def crosstab(df: DataFrame, row: str, column: str, side: int = HEATMAP_SIDE) -> DataFrame:
    """``(row, column, count)`` for the most frequent values of both columns, zeros included.

    The kept labels come from the counts of each column alone, so only pairs of kept labels
    are ever counted together.
    """
    labels = df.select(_label(df, row).alias("row"), _label(df, column).alias("column"))

    def kept(name: str) -> DataFrame:
        size = labels.groupBy(name).agg(F.count(F.lit(1)).alias("size"))
        return F.broadcast(size.orderBy(F.desc("size"), name).limit(side).select(name))  # `side` rows

    pairs = (
        labels.join(kept("row"), "row", "left_semi")
        .join(kept("column"), "column", "left_semi")
        .groupBy("row", "column")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    columns = kept("column").agg(F.collect_list("column").alias("labels"))
    grid = kept("row").select("row", F.explode(columns.scalar()).alias("column"))
    return grid.join(F.broadcast(pairs), ["row", "column"], "left").select(
        "row", "column", F.coalesce("cnt", F.lit(0)).alias("count")
    )


def line(
    df: DataFrame, time: str, values: Sequence[str], max_points: int = LINE_POINTS, tie: str | None = None
) -> DataFrame:
    names = list(dict.fromkeys([time, *values, *([tie] if tie else [])]))
    return time_series(df.select(*[c.raw for c in cells(df, names)]), time, max_points, tie)


def scatter(
    df: DataFrame, x: str, y: str, key: Sequence[str] | None = None, seed: int | str = 0, points: int = SCATTER_POINTS
) -> DataFrame:
    sampled = random_sample(df if key else df.select(x, y), points, key, seed)
    return sampled.select(x, y)


def bubble(
    df: DataFrame, x: str, y: str, size: str, key: Sequence[str] | None = None, seed: int | str = 0
) -> DataFrame:
    sampled = random_sample(df if key else df.select(x, y, size), BUBBLE_POINTS, key, seed)
    return sampled.select(x, y, size)


def table(df: DataFrame, columns: Sequence[str] | None = None, rows: int = TABLE_ROWS) -> DataFrame:
    cells(df, columns)
    return df.select(*[c.raw for c in cells(df, columns or None)]).limit(rows)


def chart_data(df: DataFrame, kind: str, **config) -> DataFrame:
    """Data of one chart; an unknown kind, option or column raises."""
    if kind not in KINDS:
        raise ValueError(f"unknown chart type: {kind}")
    return KINDS[kind](df, **config)


KINDS = {
    "bar": bar,
    "horizontalBar": horizontal_bar,
    "line": line,
    "scatter": scatter,
    "bubble": bubble,
    "pie": pie,
    "histogram": lambda df, value, bins=HISTOGRAM_BINS: histogram(df, [value], bins),
    "heatmap": crosstab,
    "boxplot": boxplot,
    "correlationMatrix": chart_matrix,
    "treemap": treemap,
    "table": table,
}
