"""Time columns: range, spacing, calendar shares, gaps and evenly spaced picks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import integer_prefix, iso_text
from plumbline.operators.columns import Cell, cells, local_table, long, row_hash, wide
from plumbline.operators.ordering import (
    Target,
    bucket_edges,
    floor_index,
    grouped_order_statistics,
    order_statistics,
    partner_index,
    with_position,
    with_previous,
)
from plumbline.shared import cut

DAY_MS = 86_400_000.0

# Upper limits in days of the median gap, with the name of the spacing.
SPACINGS = (
    (0.042, "sub-hourly"),
    (0.125, "hourly"),
    (2.5, "daily"),
    (9.0, "weekly"),
    (15.0, "bi-weekly"),
    (45.0, "monthly"),
    (135.0, "quarterly"),
    (270.0, "semi-annual"),
    (450.0, "annual"),
)
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def time_cells(df: DataFrame, columns: Iterable[str] | None) -> list[Cell]:
    picked = cells(df, columns)
    return picked if columns is not None else [c for c in picked if c.is_time]


def temporal_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: valid and missing counts, first and last moment, range in days."""
    t = wide(
        df,
        time_cells(df, columns),
        lambda c: {
            "count": F.count(F.lit(1)),
            "valid_count": F.count(c.millis()),
            "min_ms": F.min(c.millis()),
            "max_ms": F.max(c.millis()),
        },
    )
    missing = F.col("count") - F.col("valid_count")
    return t.select(
        "column",
        "count",
        "valid_count",
        missing.alias("missing"),
        F.try_divide(missing * 100.0, F.col("count").cast("double")).alias("missing_pct"),
        iso_text(F.col("min_ms")).alias("min"),
        iso_text(F.col("max_ms")).alias("max"),
        ((F.col("max_ms") - F.col("min_ms")) / F.lit(DAY_MS)).alias("range_days"),
    )


def temporal_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Basic statistics of the moments in milliseconds, with ISO text of both ends."""
    picked = time_cells(df, columns)

    def aggs(c: Cell):
        ms = c.millis().cast("double")
        n = F.count(ms)
        return {
            "count": n,
            "min_ms": F.min(c.millis()),
            "max_ms": F.max(c.millis()),
            "mean": F.avg(ms),
            "variance": F.when(n == 1, F.lit(0.0)).otherwise(F.var_pop(ms)),
        }

    targets = [Target("at", 0.5, floor_index(0.5)), Target("by", 0.5, partner_index(0.5))]
    found = order_statistics(df, {c.name: c.millis().cast("double") for c in picked}, targets)
    medians = [(n, None if f["at"] is None else (f["at"] + f["by"]) / 2) for n, f in found.items()]
    m = local_table(df.sparkSession, medians, "column string, median double")
    return wide(df, picked, aggs).join(F.broadcast(m), "column").select(
        "column",
        "count",
        "min_ms",
        "max_ms",
        (F.col("max_ms") - F.col("min_ms")).alias("range"),
        "mean",
        "median",
        "variance",
        F.sqrt("variance").alias("standard_deviation"),
        iso_text(F.col("min_ms")).alias("min_date"),
        iso_text(F.col("max_ms")).alias("max_date"),
    )


def time_gaps(df: DataFrame, column: str) -> DataFrame:
    """``(value, gap_ms, count)``: milliseconds since the previous row in time order.

    Rows sharing a moment are one row here: the first of them has the gap to the previous
    moment, and ``count - 1`` further rows have gap 0.
    """
    ms = df.select(cells(df, [column])[0].millis().cast("double").alias("value")).where(F.col("value").isNotNull())
    edges = bucket_edges(ms, {column: F.col("value")})[column]
    distinct = ms.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    spaced = with_previous(distinct, "value", edges)
    return spaced.select("value", (F.col("value") - F.col("previous")).alias("gap_ms"), "count")


def date_pattern(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(column, frequency, median_days)``: the spacing named after the median gap between rows.

    The gaps of all columns come out of one pass, whose result is written once; the medians
    are order statistics of the gaps by column.  The driver holds a few numbers per column.
    """
    picked = time_cells(df, columns)
    schema = "column string, frequency string, median_days double"
    if not picked:
        return local_table(df.sparkSession, [], schema)
    moments = {c.name: c.millis().cast("double") for c in picked}
    rows = long(df, picked, lambda c: moments[c.name]).where(F.col("value").isNotNull())
    distinct = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    spaced = with_previous(distinct, "value", bucket_edges(df, moments), "column")
    gaps = cut(spaced.select("column", (F.col("value") - F.col("previous")).alias("gap_ms"), "count"))
    sizes = {r["column"]: r for r in gaps.groupBy("column").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("moments")).collect()}
    targets, asked = {}, {}
    for name, size in sizes.items():
        if size["rows"] < 2:
            continue
        # rows that share a moment have gaps of 0, which come first
        n, zeros, rest = size["rows"] - 1, size["rows"] - size["moments"], size["moments"] - 1
        asked[name] = {floor_index(0.5)(n), partner_index(0.5)(n)}
        later = [k - zeros for k in asked[name] if k >= zeros]
        targets[name] = [Target(str(i), k / rest, lambda _n, k=k: k) for i, k in enumerate(later)]
    open_ = [n for n, t in targets.items() if t]
    found = grouped_order_statistics(gaps, F.col("column"), F.col("gap_ms"), open_, targets) if open_ else {}
    out = []
    for c in picked:
        if c.name not in asked:
            out.append((c.name, "unknown", None))
            continue
        values = [found[c.name][t.name] for t in targets[c.name]]
        days = sum(values) / len(asked[c.name]) / DAY_MS
        out.append((c.name, next((label for limit, label in SPACINGS if days < limit), "irregular"), days))
    return local_table(df.sparkSession, out, schema)


def weekday_share(df: DataFrame, column: str) -> DataFrame:
    """``(day, name, count, percentage)``, Sunday first, all seven days present."""
    return _calendar_share(df, column, F.dayofweek, WEEKDAYS, "day")


def month_share(df: DataFrame, column: str) -> DataFrame:
    """``(month, name, count, percentage)``, all twelve months present."""
    return _calendar_share(df, column, F.month, MONTHS, "month")


def _calendar_share(df: DataFrame, column: str, part, names, label: str) -> DataFrame:
    cell = cells(df, [column])[0]
    t: Column = cell.time()
    counted = df.where(t.isNotNull()).groupBy(part(t).alias(label)).agg(F.count(F.lit(1)).alias("cnt"))
    spine = local_table(df.sparkSession, list(enumerate(names, 1)), f"{label} int, name string")
    filled = spine.join(F.broadcast(counted), label, "left").withColumn("count", F.coalesce("cnt", F.lit(0)))
    total = filled.agg(F.sum("count").alias("total"))
    pct = F.try_divide(F.col("count") * 100.0, total.select("total").scalar().cast("double"))
    return filled.select(label, "name", "count", pct.alias("percentage"))


def year_gaps(df: DataFrame, column: str) -> DataFrame:
    """``(from_year, to_year)`` wherever consecutive years of the column differ by more than one."""
    cell = cells(df, [column])[0]
    year = cell.year() if cell.is_time else integer_prefix(cell.text())
    years = df.select(year.cast("double").alias("value")).where(F.col("value").isNotNull())
    edges = bucket_edges(years, {column: F.col("value")})[column]
    spaced = with_previous(years.distinct(), "value", edges)
    return spaced.where(F.col("value") > F.col("previous") + 1).select(
        F.col("previous").cast("int").alias("from_year"), F.col("value").cast("int").alias("to_year")
    )


def downsample(df: DataFrame, column: str, max_points: int = 1000, tie: str | None = None) -> DataFrame:
    """Every ``floor(n / max_points)``-th row in time order plus the last one.

    Rows without a readable time are not part of the series.  ``tie`` (a numeric column)
    orders rows that share a moment; rows that share both are ordered by two hashes of the
    whole row, so that only rows equal throughout are interchangeable.
    """
    cell = cells(df, [column])[0]
    keys = ["_ms", "_tie", "_h1", "_h2"]
    hashes = [row_hash(df, seed).alias(k) for seed, k in ((1, "_h1"), (2, "_h2"))]
    tied = cells(df, [tie])[0].raw if tie else row_hash(df)
    rows = df.select("*", cell.millis().alias("_ms"), tied.alias("_tie"), *hashes).where(F.col("_ms").isNotNull())
    # positions need the sort keys alone; whole rows are fetched for the picked keys only
    placed = with_position(rows.select(*keys), "_ms", "_tie", then=("_h1", "_h2"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(max_points)))
    wanted = (
        (F.col("total") <= max_points)
        | ((F.col("position") - 1) % step == 0)
        | (F.col("position") == F.col("total"))
    )
    picks = placed.where(wanted).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    # a null tie is a key like any other
    same = [rows[k].eqNullSafe(picks[k]) for k in keys]
    found = rows.join(picks, same).select(rows["*"], "_copies").dropDuplicates(keys)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        *[c.raw for c in cells(df)]
    )


def time_series(df: DataFrame, column: str, max_points: int = 1000, tie: str | None = None) -> DataFrame:
    """``downsample`` in time order; with ``max_points`` rows the sort is small."""
    cell = cells(df, [column])[0]
    picked = downsample(df, column, max_points, tie)
    return picked.orderBy(cell.millis(), *([cells(df, [tie])[0].raw] if tie else []))
