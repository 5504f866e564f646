"""Data profiling and data quality on Spark DataFrames."""

from plumbline.operators import column_summary, infer_types, quality_report
from plumbline.plans import analyze, chart_data, chart_profile, optimal_charts
from plumbline.sources import read_csv

__all__ = [
    "analyze",
    "chart_data",
    "chart_profile",
    "column_summary",
    "infer_types",
    "optimal_charts",
    "quality_report",
    "read_csv",
]
