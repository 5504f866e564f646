"""Equal-width histograms with every bin present."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import bin_label
from plumbline.operators.columns import long, number_cells, wide


def histogram(df: DataFrame, columns: Iterable[str] | None = None, bins: int = 10) -> DataFrame:
    """``(column, bin, bin_start, bin_end, count, density, percentage, label)``, empty bins included.

    The maximum falls in the last bin; a column with a single value fills the last bin.
    Two scans: the range of each column, then counts per bin with map-side aggregation.
    """
    picked = number_cells(df, columns)
    ranges = wide(
        df,
        picked,
        lambda c: {"lo": F.min(c.number()), "hi": F.max(c.number()), "n": F.count(c.number())},
    ).where(F.col("n") > 0)
    bounded = F.broadcast(ranges)  # one row per column
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    v = F.col("value")
    slot = F.when(v == F.col("hi"), bins - 1).otherwise(
        F.least(F.floor(F.try_divide(v - F.col("lo"), width)).cast("int"), F.lit(bins - 1))
    )
    counted = (
        long(df, picked, lambda c: c.number())
        .where(v.isNotNull())
        .join(bounded, "column")
        .groupBy("column", slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    spine = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    count = F.coalesce("cnt", F.lit(0))
    start = F.col("lo") + F.col("bin") * width
    end = F.col("lo") + (F.col("bin") + 1) * width
    filled = spine.join(F.broadcast(counted), ["column", "bin"], "left").select(  # bins rows per column
        "column",
        "bin",
        start.alias("bin_start"),
        end.alias("bin_end"),
        count.alias("count"),
        (count / F.col("n").cast("double")).alias("density"),
        (count * 100.0 / F.col("n").cast("double")).alias("percentage"),
    )
    return filled.withColumn("label", bin_label(F.col("bin_start"), F.col("bin_end")))
