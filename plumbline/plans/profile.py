"""Column profiles that recommendations and insights are derived from."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import cells, local_table, settle, wide
from plumbline.operators.frequency import cardinality, categorical_profile, continuity
from plumbline.operators.histogram import histogram
from plumbline.operators.infer import default_aggregates, default_type, type_map
from plumbline.operators.ordering import doubles_sql
from plumbline.operators.quantiles import quartile_profile
from plumbline.operators.summary import moments
from plumbline.shared import spread

TEMPORAL = ("temporal", "date")


def _named(types: Mapping[str, str], *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t in wanted]


def numeric_profile(df: DataFrame, columns=None) -> DataFrame:
    """Moments, quartiles, outliers and missing share of each numeric column, one row each."""
    m = moments(df, columns).select(
        "*", F.try_divide((F.col("rows") - F.col("count")) * 100.0, F.col("rows").cast("double")).alias("missing_pct")
    )
    q = quartile_profile(df, columns).select(
        "column", "mid", "median", "quantile_25", "quantile_75", "lower_bound", "upper_bound", "outliers", "outlier_pct"
    )
    return m.join(F.broadcast(q), "column")  # one row per column


def numeric_histograms(df: DataFrame, columns=None, bins: int = 10) -> DataFrame:
    return histogram(df, columns, bins)


# Sketches answer a yes or no only where it holds this far to both sides: shares of rows, and of distinct values.
RANK_MARGIN = 0.003
DISTINCT_LG_K = 14  # a standard error below 0.01
DISTINCT_MARGIN = 0.05
# Fewer distinct values than this are counted exactly.
FEW_VALUES = 1000
SKETCH_K = 4096
LADDER = 1000


def _column_facts(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Per column, from one scan: counts for its type, sum and mean, sketches of distinct values and of quantiles.

    ``q`` holds the approximate quantiles at ``LADDER`` equal steps.
    """
    shares = F.expr(doubles_sql([i / LADDER for i in range(LADDER + 1)]))
    distinct = lambda v: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(DISTINCT_LG_K)))
    sketch = lambda c: F.call_function("kll_sketch_agg_double", c.number(), F.lit(SKETCH_K))

    def aggregates(c):
        return default_aggregates(c) | {
            "n": F.count(c.number()),
            "sum": F.coalesce(F.sum(c.number()), F.lit(0.0)),
            "mean": F.avg(c.number()),
            "values": distinct(c.number()),
            "texts": distinct(c.text()),
            "q": F.when(F.count(c.number()) > 0, F.call_function("kll_sketch_get_quantile_double", sketch(c), shares)),
        }

    state = wide(df, cells(df, names), aggregates)
    state = state.withColumn("type", default_type())
    rows = state.select("column", "type", "rows", "filled", "n", "sum", "mean", "values", "texts", "q").collect()  # a row per column
    return {r["column"]: r.asDict() for r in rows}


def _sure(least: float, most: float, limit: float) -> bool | None:
    """Whether a number is above the limit, if all it can be agrees."""
    return True if least > limit else False if most <= limit else None


def _judged(f: dict) -> dict[str, bool | None]:
    """What sketches alone can say of a numeric column: None where only exact numbers can."""
    n = f["n"]
    if not n:
        return {"is_continuous": False, "skewed": False, "has_outliers": False}
    few, many = f["values"] * (1 - DISTINCT_MARGIN), f["values"] * (1 + DISTINCT_MARGIN)
    q = f["q"]
    q1, mid, q3 = ((q[round((p - RANK_MARGIN) * LADDER)], q[round((p + RANK_MARGIN) * LADDER)]) for p in (0.25, 0.5, 0.75))
    lo, hi = abs(f["mean"] - mid[0]), abs(f["mean"] - mid[1])
    inside = mid[0] <= f["mean"] <= mid[1]
    # shares of rows beyond the widest and the narrowest that the fences can be
    below = [bisect_left(q, 2.5 * q1[0] - 1.5 * q3[1]) / LADDER, bisect_left(q, 2.5 * q1[1] - 1.5 * q3[0]) / LADDER]
    above = [1 - bisect_right(q, 2.5 * q3[1] - 1.5 * q1[0]) / LADDER, 1 - bisect_right(q, 2.5 * q3[0] - 1.5 * q1[1]) / LADDER]
    margin = 2 * RANK_MARGIN + 2 / LADDER
    return {
        "is_continuous": False if n < 10 else _sure(few, many, n * 0.2),
        "skewed": False if n <= 20 else _sure(0.0 if inside else min(lo, hi), max(lo, hi), abs(f["mean"]) * 0.2),
        "has_outliers": _sure(below[0] + above[0] - margin, below[1] + above[1] + margin, 0.05),
    }


PROFILE_SCHEMA = (
    "column string, ordinal int, type string, rows bigint, missing bigint, n bigint, distinct bigint, is_continuous boolean, "
    "is_percentage boolean, skewed boolean, has_outliers boolean, cardinality bigint"
)


def chart_profile(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column with what the chart rules ask about.

    ``column, ordinal, type, rows, missing, n, distinct, is_continuous, is_percentage,
    skewed, has_outliers, cardinality``.  One scan keeps sketches of all columns; an answer
    that a sketch leaves open, and the cardinality of categories of few values, are counted
    exactly.  ``distinct`` and larger cardinalities are estimates where nothing depends on
    the exact number.
    """
    df = spread(df)
    facts = _column_facts(df, list(types) if types else df.columns)
    types = dict(types or {c: f["type"] for c, f in facts.items()})
    numeric, categorical = _named(types, "numeric"), _named(types, "categorical")
    said = {c: _judged(facts[c]) for c in numeric}
    distinct = {c: facts[c]["values"] for c in numeric}
    open_ = [c for c in numeric if said[c]["is_continuous"] is None]
    if open_:
        for r in continuity(df, open_).collect():
            distinct[r["column"]], said[r["column"]]["is_continuous"] = r["distinct"], r["is_continuous"]
    open_ = [c for c in numeric if None in said[c].values()]
    if open_:
        for r in numeric_profile(df, open_).collect():
            skewed = r["count"] > 20 and abs(r["mean"] - r["mid"]) > abs(r["mean"]) * 0.2
            said[r["column"]] |= {"skewed": skewed, "has_outliers": r["outliers"] > r["count"] * 0.05}
    held = {c: facts[c]["texts"] for c in categorical}
    few = [c for c in categorical if held[c] <= FEW_VALUES]
    if few:
        held |= {r["column"]: r["cardinality"] for r in cardinality(df, few).collect()}
    rows = []
    for i, c in enumerate(df.columns):
        if c not in types:
            continue
        f, j = facts[c], said.get(c, {})
        whole = abs(f["sum"] - 100) < 5 or abs(f["sum"] - 1) < 0.05
        rows.append((
            c, i, types[c], f["rows"], f["rows"] - f["filled"], f["n"] if j else None, distinct.get(c), j.get("is_continuous", False),
            bool(j) and whole, j.get("skewed", False), j.get("has_outliers", False), held.get(c),
        ))
    return local_table(df.sparkSession, rows, PROFILE_SCHEMA)


def feature_profile(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column with what the insight rules ask about."""
    types = dict(types or type_map(df, "metadata"))
    numeric, temporal = _named(types, "numeric"), _named(types, *TEMPORAL)
    rest = [c for c in types if c not in numeric and c not in temporal]
    parts = []
    if numeric:
        parts.append(
            numeric_profile(df, numeric).select(
                "column",
                (F.col("rows") - F.col("count")).alias("missing"),
                "missing_pct",
                "outliers",
                "outlier_pct",
                "skewness",
                "variance",
            )
        )
    if temporal:
        parts.append(
            wide(
                df,
                cells(df, temporal),
                lambda c: {"rows": F.count(F.lit(1)), "missing": F.count_if(c.time().isNull())},
            ).select(
                "column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("rows").cast("double")).alias("missing_pct")
            )
        )
    if rest:
        parts.append(
            categorical_profile(df, rest).select(
                "column", "missing", "missing_pct", "unique_values", "most_frequent", "most_pct"
            )
        )
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p, allowMissingColumns=True)
    for name, kind in (
        ("outliers", "bigint"), ("outlier_pct", "double"), ("skewness", "double"), ("variance", "double"),
        ("unique_values", "bigint"), ("most_frequent", "string"), ("most_pct", "double"),
    ):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    names = local_table(
        df.sparkSession, [(c, i, t) for i, (c, t) in enumerate(types.items())], "column string, ordinal int, type string"
    )
    return settle(names.join(F.broadcast(facts), "column"))
