"""Writing results.  Each sink writes a folder of part files from the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

EXPORTED_ROWS = 20


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quality findings as JSON lines."""
    issues.write.mode(mode).json(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite", skip=("input",)) -> None:
    """Every result table as JSON lines in a folder of its own."""
    for name, df in tables.items():
        if name not in skip:
            df.write.mode(mode).json(f"{path}/{name}")


def write_preview(df: DataFrame, path: str, rows: int = EXPORTED_ROWS, mode: str = "overwrite") -> None:
    """The first rows as CSV with a header and every cell quoted."""
    df.limit(rows).write.mode(mode).option("header", True).option("quoteAll", True).csv(path)


def write_insights(insights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Insight sentences, one per line."""
    insights.select("description").write.mode(mode).text(path)
