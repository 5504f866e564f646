"""Quantiles, interquartile outliers and box plots on exact order statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import Cell, cells, local_table, number_cells, wide
from plumbline.operators.ordering import Target, floor_index, grouped_order_statistics, order_statistics, partner_index

MAX_BOXES = 15


def _positions(df: DataFrame, picked: Sequence[Cell], targets: Sequence[Target]) -> dict[str, dict]:
    return order_statistics(df, {c.name: c.number() for c in picked}, targets)


def order_stats(
    df: DataFrame, columns: Iterable[str] | None = None, shares: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(column, p, k, value)`` with ``value = sorted[floor(n * p)]``."""
    targets = [Target(str(p), p, floor_index(p)) for p in shares]
    found = _positions(df, number_cells(df, columns), targets)
    rows = [
        (name, t.p, t.index(f["n"]) if f["n"] else None, f[t.name]) for name, f in found.items() for t in targets
    ]
    return local_table(df.sparkSession, rows, "column string, p double, k bigint, value double")


def averaging_targets(shares: Sequence[float]) -> list[Target]:
    """Both positions a share may need: ``floor(n * p)`` and its averaging partner."""
    return [
        t for p in shares for t in (Target(f"at{p}", p, floor_index(p)), Target(f"by{p}", p, partner_index(p)))
    ]


def averaged(found: dict, p: float) -> float | None:
    at, by = found[f"at{p}"], found[f"by{p}"]
    return None if at is None else (at + by) / 2


def quantiles(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    shares: Sequence[float] = (0.25, 0.5, 0.75),
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """``(column, p, quantile)``.

    Exact rule: position ``n * p``; the mean of two neighbours when it is whole and ``n``
    even, else the value at its floor.  ``approximate`` answers from the sketch alone.
    """
    picked = number_cells(df, columns)
    if approximate:
        sk = wide(df, picked, lambda c: {"q": F.percentile_approx(c.number(), list(shares), accuracy)})
        ps = F.array(*[F.lit(float(p)) for p in shares])
        z = F.explode(F.arrays_zip(ps.alias("p"), F.col("q").alias("quantile"))).alias("z")
        return sk.select("column", z).select("column", "z.p", "z.quantile")
    found = _positions(df, picked, averaging_targets(shares))
    rows = [(name, float(p), averaged(f, p)) for name, f in found.items() for p in shares]
    return local_table(df.sparkSession, rows, "column string, p double, quantile double")


def quartile_table(df: DataFrame, picked: Sequence[Cell], reach: float = 1.5) -> dict[str, dict]:
    """Per column: n, min, max, ``q1``/``mid``/``q3`` at ``floor(n * p)``, averaged quartiles, fences."""
    found = _positions(df, picked, averaging_targets((0.25, 0.5, 0.75)))
    out = {}
    for name, f in found.items():
        q1, q3 = f["at0.25"], f["at0.75"]
        lower, upper = fences(q1, q3, reach)
        out[name] = {
            "n": f["n"],
            "min": f["min"],
            "max": f["max"],
            "q1": q1,
            "mid": f["at0.5"],
            "q3": q3,
            "quantile_25": averaged(f, 0.25),
            "median": averaged(f, 0.5),
            "quantile_75": averaged(f, 0.75),
            "lower_bound": lower,
            "upper_bound": upper,
        }
    return out


def fences(q1: float | None, q3: float | None, reach: float = 1.5) -> tuple[float | None, float | None]:
    """Bounds ``reach`` interquartile ranges beyond the quartiles."""
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    return q1 - reach * iqr, q3 + reach * iqr


def outside(v: Column, lower: float | None, upper: float | None) -> Column:
    """Beyond the fences; false for every row of a column without values."""
    return (v < F.lit(lower).cast("double")) | (v > F.lit(upper).cast("double"))


QUARTILE_FIELDS = (
    "n", "min", "max", "q1", "mid", "q3", "quantile_25", "median", "quantile_75", "lower_bound", "upper_bound",
)


def quartile_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: quartiles by both rules, fences, number and share of outliers."""
    picked = number_cells(df, columns)
    table = quartile_table(df, picked)

    def beyond(c: Cell):
        q = table[c.name]
        return {"outliers": F.count_if(outside(c.number(), q["lower_bound"], q["upper_bound"]))}

    counted = wide(df, picked, beyond)
    known = local_table(df.sparkSession, 
        [(name, *[q[f] for f in QUARTILE_FIELDS]) for name, q in table.items()],
        "column string, n bigint, " + ", ".join(f"{f} double" for f in QUARTILE_FIELDS[1:]),
    )
    # both sides hold one row per column
    return counted.join(F.broadcast(known), "column").select(
        "*",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        F.try_divide(F.col("outliers") * 100.0, F.col("n").cast("double")).alias("outlier_pct"),
    )


def iqr_outliers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: quartiles, fences, number and share of values beyond them."""
    return quartile_profile(df, columns).select(
        "column", "n", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outliers", "outlier_pct"
    )


def outlier_values(df: DataFrame, column: str) -> DataFrame:
    """The outlying values themselves, each with its number of occurrences."""
    cell = cells(df, [column])[0]
    q = quartile_table(df, [cell])[column]
    v = cell.number().alias("value")
    return (
        df.select(v)
        .where(outside(F.col("value"), q["lower_bound"], q["upper_bound"]))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _boxes(df: DataFrame, value: str, category: str | None, max_boxes: int) -> tuple[DataFrame, DataFrame]:
    """``(category, v)`` rows of the drawn categories, and a table of their boxes."""
    num = cells(df, [value])[0].number()
    targets = [Target(n, p, floor_index(p)) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    if category is None:
        label = F.lit(value)
        found = order_statistics(df, {value: num}, targets)
    else:
        label = F.coalesce(cells(df, [category])[0].text(), F.lit(""))
        top = (
            df.groupBy(label.alias("category"))
            .agg(F.count(F.lit(1)).alias("size"))
            .orderBy(F.desc("size"), "category")
            .limit(max_boxes)
        )
        found = grouped_order_statistics(df, label, num, [r["category"] for r in top.collect()], targets)
    rows = []
    for name, f in found.items():
        lower, upper = fences(f["q1"], f["q3"])
        low = None if lower is None else max(f["min"], lower)
        high = None if upper is None else min(f["max"], upper)
        rows.append((name, f["n"], low, f["q1"], f["median"], f["q3"], high))
    table = local_table(df.sparkSession, rows, "category string, n bigint, min double, q1 double, median double, q3 double, max double")
    return df.select(label.alias("category"), num.alias("v")), table


def _beyond(rows: DataFrame, table: DataFrame) -> DataFrame:
    whiskers = F.broadcast(table.select("category", "min", "max"))  # one row per drawn category
    return rows.join(whiskers, "category").where((F.col("v") < F.col("min")) | (F.col("v") > F.col("max")))


def boxplot(df: DataFrame, value: str, category: str | None = None, max_boxes: int = MAX_BOXES) -> DataFrame:
    """Box per category: quartiles at ``floor(n * p)``, whiskers kept within the data, outlier count.

    With more categories than ``max_boxes`` the most frequent are drawn.
    Without ``category`` there is one box for the whole column.
    """
    rows, table = _boxes(df, value, category, max_boxes)
    counted = _beyond(rows, table).groupBy("category").agg(F.count(F.lit(1)).alias("beyond"))
    return table.join(F.broadcast(counted), "category", "left").select(
        "category", "n", "min", "q1", "median", "q3", "max", F.coalesce("beyond", F.lit(0)).alias("outliers")
    )


def boxplot_outliers(
    df: DataFrame, value: str, category: str | None = None, max_boxes: int = MAX_BOXES
) -> DataFrame:
    """``(category, value, count)`` of the values beyond the whiskers."""
    rows, table = _boxes(df, value, category, max_boxes)
    return _beyond(rows, table).groupBy("category", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count"))
