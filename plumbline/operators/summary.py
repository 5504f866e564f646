"""Column summaries: counts, moments, shape and the checks charts are chosen by."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_text
from plumbline.operators.columns import Cell, cells, number_cells, wide


def type_by_share(numeric: Column, text: Column) -> Column:
    """Numeric above nine tenths, mixed when both kinds occur, else categorical."""
    share = F.try_divide(numeric.cast("double"), (numeric + text).cast("double"))
    return (
        F.when(share > 0.9, "numeric").when((numeric > 0) & (text > 0), "mixed").otherwise("categorical")
    )


def summary_aggregates(c: Cell) -> Mapping[str, Column]:
    """The mergeable state of a column summary."""
    num = c.number("strict")
    present = ~c.missing
    return {
        "count": F.count_if(present),
        "null_count": F.count_if(c.missing),
        "numeric_count": F.count(num),
        "text_count": F.count_if(present & num.isNull()),
        "sum": F.coalesce(F.sum(num), F.lit(0.0)),
        "min": F.min(num),
        "max": F.max(num),
    }


def finish_summary(state: DataFrame) -> DataFrame:
    return state.select(
        "*",
        F.try_divide("sum", F.col("numeric_count").cast("double")).alias("mean"),
        F.when(
            F.col("numeric_count") > 0, F.try_divide("sum", F.col("count").cast("double"))
        ).alias("mean_nonempty"),
        type_by_share(F.col("numeric_count"), F.col("text_count")).alias("data_type"),
    )


def column_summary(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: counts by kind of cell, sum, min, max, means and type, in one scan.

    ``mean`` divides by the numeric cells, ``mean_nonempty`` by all non-empty ones.
    """
    return finish_summary(wide(df, cells(df, columns), summary_aggregates))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric columns, text columns."""
    s = column_summary(df)
    return s.agg(
        F.max(F.col("count") + F.col("null_count")).alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("data_type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("data_type") == "categorical").alias("text_columns"),
    )


def moment_aggregates(c: Cell, reader: str = "loose", ddof: int = 0) -> Mapping[str, Column]:
    num = c.number(reader)
    var = F.var_pop if ddof == 0 else F.var_samp
    n = F.count(num)
    one = n == 1
    return {
        "count": n,
        "missing": F.count_if(c.missing),
        "rows": F.count(F.lit(1)),
        "min": F.min(num),
        "max": F.max(num),
        "sum": F.sum(num),
        "mean": F.avg(num),
        "variance": F.when(one, F.lit(0.0)).otherwise(var(num)),
        "skewness": F.when(n >= 4, F.skewness(num)),
        "kurtosis": F.when(n >= 4, F.kurtosis(num)),
    }


def moments(
    df: DataFrame, columns: Iterable[str] | None = None, reader: str = "loose", ddof: int = 0
) -> DataFrame:
    """Min, max, range, mean, variance, deviation, skewness, excess kurtosis and shape per column.

    Population moments by default; ``ddof=1`` gives the sample variance.  Skewness and
    kurtosis need four values.
    """
    m = wide(df, number_cells(df, columns), lambda c: moment_aggregates(c, reader, ddof))
    return with_shape(
        m.withColumn("range", F.col("max") - F.col("min")).withColumn("standard_deviation", F.sqrt("variance"))
    )


def with_shape(m: DataFrame) -> DataFrame:
    return m.select(
        "*",
        ((F.abs("skewness") < 0.5) & (F.abs("kurtosis") < 0.5)).alias("appears_normal"),
        F.when(F.col("skewness") > 0.5, "right-skewed")
        .when(F.col("skewness") < -0.5, "left-skewed")
        .when(F.col("skewness").isNotNull(), "symmetric")
        .alias("shape"),
    )


def percentage_check(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Does the column add up to a whole, near 100 or near 1?"""
    s = wide(
        df,
        number_cells(df, columns),
        lambda c: {"sum": F.coalesce(F.sum(c.number()), F.lit(0.0))},
    )
    return s.withColumn("is_percentage", looks_like_whole(F.col("sum")))


def looks_like_whole(total: Column) -> Column:
    return (F.abs(total - 100) < 5) | (F.abs(total - 1) < 0.05)


def missing_share_warnings(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = 20.0
) -> DataFrame:
    """Numeric columns with more than ``threshold`` per cent of missing cells."""
    s = wide(
        df,
        number_cells(df, columns),
        lambda c: {"missing": F.count_if(c.missing), "rows": F.count(F.lit(1))},
    )
    pct = F.try_divide(F.col("missing") * 100.0, F.col("rows").cast("double"))
    return (
        s.withColumn("missing_pct", pct)
        .where(F.col("missing_pct") > threshold)
        .select(
            "column",
            "missing",
            "missing_pct",
            F.format_string(
                'Column "%s" has %s%% missing values', "column", fixed_text(F.col("missing_pct"), 1)
            ).alias("message"),
        )
    )
