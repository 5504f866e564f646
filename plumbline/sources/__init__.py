from plumbline.sources.readers import csv_files, preview, read_csv, read_table, table_catalog
from plumbline.sources.sinks import write_insights, write_issues, write_preview, write_tables

__all__ = [
    "csv_files",
    "preview",
    "read_csv",
    "read_table",
    "table_catalog",
    "write_insights",
    "write_issues",
    "write_preview",
    "write_tables",
]
