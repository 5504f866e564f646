"""Reading tables: CSV as text cells, typed formats as they are."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.columns import local_table

PREVIEW_ROWS = 100


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """CSV with a header; every cell is a string, empty cells are NULL.

    No inference pass: types come from ``infer_types``.  Files split across tasks unless
    ``multi_line`` is needed for quoted line breaks.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if not df.columns:
        raise ValueError(f"no columns: {path}")
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.options(**options).format(fmt).load(path)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)


def table_catalog(tables: Mapping[str, DataFrame | Exception | None]) -> DataFrame:
    """``(name, status, row_count, column_count)`` of each table.

    ``None`` stands for a table still being produced, an exception for one that failed.
    """
    spark = next((t.sparkSession for t in tables.values() if isinstance(t, DataFrame)), None)
    if spark is None:
        spark = SparkSession.active()
    schema = "name string, status string, row_count bigint, column_count int"
    absent = [
        (name, "processing" if t is None else "error", None, None)
        for name, t in tables.items()
        if not isinstance(t, DataFrame)
    ]
    parts = [local_table(spark, absent, schema)]
    for name, t in tables.items():
        if isinstance(t, DataFrame):
            parts.append(
                t.agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(name).alias("name"),
                    F.lit("ready").alias("status"),
                    "row_count",
                    F.lit(len(t.columns)).alias("column_count"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, path, length)`` of the CSV files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
