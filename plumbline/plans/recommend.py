"""Chart recommendations: rules as filters and joins over a column profile.

The profile has one row per column, so nothing here grows with the data.  Every function
returns ``(seq, type, priority, category, x, y, size, columns, title)``; ``columns`` lists
the drawn columns where there is more than one, ``y`` is NULL where rows are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import local_table
from plumbline.operators.correlation import column_pairs
from plumbline.operators.reconcile import new_rows

TEMPORAL = ("temporal", "date")

# The group a chart is listed under, by chart type.
CATEGORY_OF = {
    "histogram": "distributions",
    "boxplot": "distributions",
    "line": "time_series",
    "scatter": "correlations",
    "bubble": "correlations",
    "correlationMatrix": "correlations",
    "bar": "categorical_analysis",
    "horizontalBar": "categorical_analysis",
    "pie": "categorical_analysis",
    "treemap": "categorical_analysis",
    "heatmap": "categorical_analysis",
}
# Rule limits.
BAR_CATEGORIES = 10
PIE_CATEGORIES = 7
TREEMAP_CATEGORIES = 20
HEATMAP_CATEGORIES = 20
SMALL_TABLE = 50
DEFAULT_LIMIT = 10
COUNT = "count"


def _ranked(rows: DataFrame) -> DataFrame:
    """Column rows with their 1-based place among themselves (one row per column)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("type_group").orderBy("ordinal")))


def _groups(profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numeric, categorical and temporal columns, each with ``place``."""
    group = (
        F.when(F.col("type") == "numeric", "numeric")
        .when(F.col("type") == "categorical", "categorical")
        .when(F.col("type").isin(*TEMPORAL), "temporal")
    )
    ranked = _ranked(profile.withColumn("type_group", group).where(F.col("type_group").isNotNull()))
    return tuple(ranked.where(F.col("type_group") == g) for g in ("numeric", "categorical", "temporal"))


def _charts(
    rows: DataFrame,
    section: int,
    type_: str | Column,
    priority: str,
    category: str | None,
    title: Column,
    x: Column | None = None,
    y: Column | None = None,
    size: Column | None = None,
    columns: Column | None = None,
    order: tuple = (),
) -> DataFrame:
    """Recommendation rows out of a rule's matches; ``order`` holds the sort keys inside the section."""
    kind = F.lit(type_) if isinstance(type_, str) else type_
    none = F.lit(None).cast("string")
    keys = list(order) + [F.lit(0)] * (3 - len(order))
    return rows.select(
        F.lit(section).alias("section"),
        *[k.cast("int").alias(f"k{i}") for i, k in enumerate(keys)],
        kind.alias("type"),
        F.lit(priority).alias("priority"),
        (F.lit(category) if category else category_of(kind)).alias("category"),
        (x if x is not None else none).alias("x"),
        (y if y is not None else none).alias("y"),
        (size if size is not None else none).alias("size"),
        (columns if columns is not None else F.lit(None).cast("array<string>")).alias("columns"),
        title.alias("title"),
    )


def category_of(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for chart, group in CATEGORY_OF.items():
        out = out.when(kind == chart, group)
    return out.otherwise("other")


def _finish(parts: list[DataFrame], limit: int | None = None, by_priority: bool = False) -> DataFrame:
    """Numbers the rows of all rules in order; a few dozen rows."""
    every = reduce(DataFrame.unionByName, parts)
    keys = ["section", "k0", "k1", "k2"]
    if by_priority:
        rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
        every = every.withColumn("prio", rank)
        keys = ["prio", *keys]
    seq = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys))
    out = every.withColumn("seq", seq).select(
        "seq", "type", "priority", "category", "x", "y", "size", "columns", "title"
    )
    return out if limit is None else out.where(F.col("seq") <= limit)


def _names(rows: DataFrame) -> Column:
    """Column names in table order, as an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda s: s["column"])


def _facts(profile: DataFrame) -> DataFrame:
    """One row: column names per type, and the details of the first of each."""
    num, cat, time = _groups(profile)

    def gathered(rows: DataFrame, name: str, *details: str) -> DataFrame:
        first = [F.max(F.when(F.col("place") == 1, F.col(d))).alias(d) for d in details]
        return rows.agg(_names(rows).alias(name), *first, F.lit(1).alias("one"))

    n = gathered(num, "nums", "is_percentage", "is_continuous")
    c = gathered(cat, "cats", "cardinality")
    t = gathered(time, "times")
    every = profile.agg(_names(profile).alias("every"), F.lit(1).alias("one"))
    return n.join(c, "one").join(t, "one").join(every, "one").drop("one")  # one row each


def select_chart(profile: DataFrame) -> DataFrame:
    """The one chart that suits the table as a whole.

    Shares of a whole are tested before plain comparison, so pies and treemaps can occur.
    """
    f = _facts(profile)
    nn, nc, nt = F.size("nums"), F.size("cats"), F.size("times")
    num = [F.get("nums", F.lit(i)) for i in range(3)]
    cat = [F.get("cats", F.lit(i)) for i in range(2)]
    few = F.col("cardinality") <= PIE_CATEGORIES
    one_each = (nc == 1) & (nn == 1)
    kind = (
        F.when((nt == 1) & (nn >= 1), "line")
        .when(one_each & F.col("is_percentage") & few, "pie")
        .when(one_each & F.col("is_percentage"), "treemap")
        .when(one_each & (F.col("cardinality") > BAR_CATEGORIES), "horizontalBar")
        .when(one_each, "bar")
        .when(nn == 2, "scatter")
        .when(nn >= 3, "bubble")
        .when((nn == 1) & F.col("is_continuous"), "histogram")
        .when(nc >= 2, "heatmap")
        .otherwise("table")
    )
    k = F.col("type")
    by_group = k.isin("pie", "treemap", "bar", "horizontalBar")
    x = (
        F.when(k == "line", F.get("times", F.lit(0)))
        .when(by_group, cat[0])
        .when(k.isin("scatter", "bubble", "histogram"), num[0])
        .when(k == "heatmap", cat[0])
    )
    y = F.when(by_group, num[0]).when(k.isin("scatter", "bubble"), num[1]).when(k == "heatmap", cat[1])
    cols = F.when(k == "line", F.col("nums")).when(k == "table", F.col("every"))
    title = (
        F.when(k == "line", F.concat(F.lit("Time Series of "), F.array_join("nums", ", ")))
        .when(k.isin("pie", "treemap"), F.format_string("Distribution of %s by %s", num[0], cat[0]))
        .when(k.isin("bar", "horizontalBar"), F.format_string("%s by %s", num[0], cat[0]))
        .when(k == "scatter", F.format_string("%s vs %s", num[1], num[0]))
        .when(k == "bubble", F.format_string("%s vs %s (size: %s)", num[1], num[0], num[2]))
        .when(k == "histogram", F.format_string("Distribution of %s", num[0]))
        .when(k == "heatmap", F.format_string("Relationship between %s and %s", cat[0], cat[1]))
        .otherwise("Data Table")
    )
    chosen = f.withColumn("type", kind)
    return _finish(
        [_charts(chosen, 0, k, "high", None, title, x, y, F.when(k == "bubble", num[2]), cols)]
    )


def select_chart_for(profile: DataFrame, x: str, y: str, size: str | None = None) -> DataFrame:
    """The chart that suits two given columns."""
    px = profile.where(F.col("column") == x).select(
        F.col("column").alias("xc"), F.col("type").alias("xt"), F.col("cardinality").alias("xn")
    )
    py = profile.where(F.col("column") == y).select(F.col("column").alias("yc"), F.col("type").alias("yt"))
    sized = F.lit(False)
    if size is not None:
        kinds = profile.where(F.col("column") == size).agg(F.first("type").alias("t")).scalar()
        sized = F.coalesce(kinds == "numeric", F.lit(False))
    both = px.join(F.broadcast(py), F.lit(x).isNotNull())  # one row on each side
    xt, yt = F.col("xt"), F.col("yt")
    kind = (
        F.when(xt.isin(*TEMPORAL) & (yt == "numeric"), "line")
        .when((xt == "categorical") & (yt == "numeric") & (F.col("xn") > BAR_CATEGORIES), "horizontalBar")
        .when((xt == "categorical") & (yt == "numeric"), "bar")
        .when((xt == "numeric") & (yt == "numeric") & sized, "bubble")
        .when((xt == "numeric") & (yt == "numeric"), "scatter")
        .when((xt == "categorical") & (yt == "categorical"), "heatmap")
        .when((xt == "numeric") & (yt == "categorical"), "boxplot")
        .otherwise("table")
    )
    k, xc, yc = F.col("type"), F.col("xc"), F.col("yc")
    swap = k == "boxplot"
    title = (
        F.when(k == "line", F.format_string("%s over Time", yc))
        .when(k.isin("bar", "horizontalBar"), F.format_string("%s by %s", yc, xc))
        .when(k == "bubble", F.format_string("%s vs %s (size: %s)", yc, xc, F.lit(size or "")))
        .when(k == "scatter", F.format_string("%s vs %s", yc, xc))
        .when(k == "heatmap", F.format_string("Relationship between %s and %s", xc, yc))
        .when(swap, F.format_string("Distribution of %s by %s", xc, yc))
        .otherwise("Data Table")
    )
    chosen = both.withColumn("type", kind)
    return _finish(
        [
            _charts(
                chosen, 0, k, "high", None, title, F.when(swap, yc).otherwise(xc), F.when(swap, xc).otherwise(yc),
                F.when(k == "bubble", F.lit(size)), F.when(k == "table", F.array(xc, yc)),
            )
        ]
    )


def _placed_pairs(num: DataFrame) -> DataFrame:
    """Numeric pairs in column order with both places."""
    slim = num.select("column", F.col("place").alias("ordinal"))
    return column_pairs(slim)


def _first_pairs(num: DataFrame, k: int) -> DataFrame:
    return _placed_pairs(num).orderBy("ord_x", "ord_y").limit(k)


def _against(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left column with each right column, as ``(a, a_ord, b, b_ord)`` plus left details."""
    a = left.select(
        F.col("column").alias("a"), F.col("place").alias("a_ord"), "cardinality", F.col("type_group").alias("a_group")
    )
    b = right.select(F.col("column").alias("b"), F.col("place").alias("b_ord"), F.col("type_group").alias("b_group"))
    return a.join(F.broadcast(b), F.col("a_group") != F.col("b_group"))  # one row per column on both sides


def recommend_charts(profile: DataFrame) -> DataFrame:
    """Everything worth drawing, in rule order."""
    num, cat, time = _groups(profile)
    first_time = time.where(F.col("place") == 1)
    over_time = _against(first_time, num)
    pairs = _first_pairs(num, 5)
    matrix = num.agg(_names(num).alias("names")).where(F.size("names") > 2)
    breakdown = _against(cat, num)
    return _finish(
        [
            _charts(
                num.where("is_continuous"), 1, "histogram", "high", "distributions",
                F.format_string("Distribution of %s", "column"), x=F.col("column"), order=(F.col("place"),),
            ),
            _charts(
                over_time, 2, "line", "high", "time_series", F.format_string("%s over Time", "b"),
                x=F.col("a"), columns=F.array("b"), order=(F.col("b_ord"),),
            ),
            _charts(
                pairs, 3, "scatter", "medium", "correlations", F.format_string("%s vs %s", "column_y", "column_x"),
                x=F.col("column_x"), y=F.col("column_y"), order=(F.col("ord_x"), F.col("ord_y")),
            ),
            _charts(
                matrix, 4, "correlationMatrix", "high", "correlations", F.lit("Correlation Matrix"),
                columns=F.col("names"),
            ),
            _charts(
                breakdown, 5, "bar", "medium", "categorical_analysis", F.format_string("%s by %s", "b", "a"),
                x=F.col("a"), y=F.col("b"), order=(F.col("a_ord"), F.col("b_ord")),
            ),
        ]
    )


def optimal_charts(profile: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The most telling charts, high priority first, ten by default."""
    num, cat, time = _groups(profile)
    every = profile.agg(_names(profile).alias("names"), F.max("rows").alias("rows"))
    first_three = F.slice(_names(num), 1, 3)
    top = num.agg(first_three.alias("names")).where(F.size("names") > 0)
    together = time.select("column", "place", top.select("names").scalar().alias("names")).where(
        F.col("names").isNotNull()
    )
    single = _against(time, num.where(F.col("place") > 3))
    enough = num.agg(_names(num).alias("names")).where(F.size("names") >= 2)
    n0, n1, n2 = [F.get("names", F.lit(i)) for i in range(3)]
    by_cat = _against(cat, num.where(F.col("place") == 1))
    cross = _placed_pairs(cat.where(F.col("place") <= 2))
    narrow = cat.where((F.col("place") <= 2) & (F.col("cardinality") <= HEATMAP_CATEGORIES)).agg(
        F.count(F.lit(1)).alias("narrow")
    )
    return _finish(
        [
            _charts(
                every.where(F.col("rows") < SMALL_TABLE), 1, "table", "high", "overview", F.lit("Data Overview"),
                columns=F.col("names"),
            ),
            _charts(
                num.where("is_continuous"), 2, "histogram", "high", "distributions",
                F.format_string("Distribution of %s", "column"), x=F.col("column"), order=(F.col("place"), F.lit(0)),
            ),
            _charts(
                num.where(F.col("skewed") | F.col("has_outliers")), 2, "boxplot", "high", "distributions",
                F.format_string("Boxplot of %s", "column"), x=F.col("column"), order=(F.col("place"), F.lit(1)),
            ),
            _charts(
                together, 3, "line", "high", "time_series", F.lit("Time Series Analysis"),
                x=F.col("column"), columns=F.col("names"), order=(F.col("place"), F.lit(0)),
            ),
            _charts(
                single, 3, "line", "medium", "time_series", F.format_string("%s over Time", "b"),
                x=F.col("a"), columns=F.array("b"), order=(F.col("a_ord"), F.col("b_ord")),
            ),
            _charts(
                enough, 4, "correlationMatrix", "high", "correlations", F.lit("Correlation Matrix"),
                columns=F.col("names"),
            ),
            _charts(
                _first_pairs(num, 3), 5, "scatter", "medium", "correlations",
                F.format_string("%s vs %s", "column_y", "column_x"),
                x=F.col("column_x"), y=F.col("column_y"), order=(F.col("ord_x"), F.col("ord_y")),
            ),
            _charts(
                enough.where(F.size("names") >= 3), 6, "bubble", "medium", "correlations",
                F.format_string("%s vs %s (size: %s)", n1, n0, n2), x=n0, y=n1, size=n2,
            ),
            _charts(
                by_cat, 7, F.when(F.col("cardinality") <= BAR_CATEGORIES, "bar").otherwise("horizontalBar"), "high",
                "categorical_analysis", F.format_string("%s by %s", "b", "a"), x=F.col("a"), y=F.col("b"),
                order=(F.col("a_ord"), F.lit(0)),
            ),
            _charts(
                cat.where(F.col("cardinality") <= TREEMAP_CATEGORIES), 7,
                F.when(F.col("cardinality") <= PIE_CATEGORIES, "pie").otherwise("treemap"), "medium",
                "categorical_analysis", F.format_string("Distribution of %s", "column"), x=F.col("column"),
                y=F.lit(COUNT), order=(F.col("place"), F.lit(1)),
            ),
            _charts(
                cross.where(narrow.scalar() == 2), 8, "heatmap", "medium", "categorical_analysis",
                F.format_string("Relationship between %s and %s", "column_x", "column_y"),
                x=F.col("column_x"), y=F.col("column_y"),
            ),
            _charts(enough, 9, "scatter", "low", "anomaly_detection", F.lit("Outlier Detection"), x=n0, y=n1),
        ],
        limit,
        by_priority=True,
    )


def progressive_charts(profile: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Charts in the order to show them one by one: series, pairs, distributions, categories,
    topped up from ``optimal_charts`` without repeating any."""
    num, cat, time = _groups(profile)
    over_time = _against(time.where(F.col("place") == 1), num.where(F.col("place") <= 3))
    pairs = _placed_pairs(num).where((F.col("ord_x") <= 3) & (F.col("ord_y") <= 4))
    few = cat.where(F.col("place") <= 3)
    by_cat = _against(few, num.where(F.col("place") == 1))
    own = [
        _charts(
            over_time, 1, "line", "high", "time_series", F.format_string("%s over time", "b"), x=F.col("a"),
            columns=F.array("b"), order=(F.col("b_ord"),),
        ),
        _charts(
            pairs, 2, "scatter", "medium", "correlations", F.format_string("%s vs %s", "column_x", "column_y"),
            x=F.col("column_x"), y=F.col("column_y"), order=(F.col("ord_x"), F.col("ord_y")),
        ),
        _charts(
            num.where(F.col("place") <= 5), 3, "histogram", "medium", "distributions",
            F.format_string("Distribution of %s", "column"), x=F.col("column"), order=(F.col("place"),),
        ),
        _charts(
            few, 4, "bar", "medium", "categorical_analysis", F.format_string("%s Distribution", "column"),
            x=F.col("column"), y=F.lit(COUNT), order=(F.col("place"), F.lit(0)),
        ),
        _charts(
            by_cat, 4, "bar", "medium", "categorical_analysis", F.format_string("%s by %s", "b", "a"),
            x=F.col("a"), y=F.col("b"), order=(F.col("a_ord"), F.lit(1)),
        ),
    ]
    planned = reduce(DataFrame.unionByName, own)
    room = F.lit(limit) - planned.agg(F.count(F.lit(1)).alias("n")).scalar()
    extra = optimal_charts(profile, None).where(F.col("seq") <= room)
    fresh = new_rows(extra, planned.select("type", "title", "x", "y"), ["type", "title", "x", "y"])
    topped = fresh.select(
        F.lit(9).alias("section"), F.col("seq").alias("k0"), F.lit(0).alias("k1"), F.lit(0).alias("k2"),
        "type", "priority", "category", "x", "y", "size", "columns", "title",
    )
    return _finish([*own, topped], limit)


def suggested_charts(types: DataFrame) -> DataFrame:
    """The quality report's own suggestions, from column types alone."""
    profile = types.select("column", "ordinal", "type", F.lit(None).cast("bigint").alias("cardinality"))
    num, cat, time = _groups(profile)
    first = num.where(F.col("place") == 1)
    enough = num.agg(_names(num).alias("names")).where(F.size("names") >= 2)
    return _finish(
        [
            _charts(
                _against(time.where(F.col("place") == 1), first), 1, "line", "high", None,
                F.format_string("%s Over Time", "b"), x=F.col("a"), y=F.col("b"),
            ),
            _charts(
                _placed_pairs(num.where(F.col("place") <= 2)), 2, "scatter", "high", None,
                F.format_string("%s vs %s", "column_y", "column_x"), x=F.col("column_x"), y=F.col("column_y"),
            ),
            _charts(
                enough, 3, "heatmap", "medium", None, F.lit("Correlation Matrix"), columns=F.slice("names", 1, 5)
            ),
            _charts(
                first, 4, "histogram", "medium", None, F.format_string("Distribution of %s", "column"), x=F.col("column")
            ),
            _charts(
                _against(cat.where(F.col("place") == 1), first), 5, "bar", "medium", None,
                F.format_string("%s by %s", "b", "a"), x=F.col("a"), y=F.col("b"),
            ),
        ]
    )


def by_category(charts: DataFrame) -> DataFrame:
    """``(category, charts, titles)`` in order of first appearance; charts without one get theirs by type."""
    group = F.coalesce("category", category_of(F.col("type")))
    titles = F.transform(F.sort_array(F.collect_list(F.struct("seq", "title"))), lambda s: s["title"])
    return (
        charts.groupBy(group.alias("category"))
        .agg(F.count(F.lit(1)).alias("charts"), F.min("seq").alias("first_seq"), titles.alias("titles"))
        .orderBy("first_seq")
        .drop("first_seq")
    )


def category_table(spark) -> DataFrame:
    return local_table(spark, list(CATEGORY_OF.items()), "type string, category string")
