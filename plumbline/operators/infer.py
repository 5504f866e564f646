"""Column types inferred from cell text, under the rule sets of the different modules.

Rules that look at the first rows need ``order_by`` to say which rows come first; without
it they look at all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import loose_number, parse_date, whole_number
from plumbline.operators.columns import Cell, cells, local_table, long, wide
from plumbline.operators.nested import leaves
from plumbline.operators.summary import summary_aggregates, type_by_share

POLICIES = ("default", "stream", "head", "integrity", "metadata", "plan", "accuracy")


def infer_types(
    df: DataFrame,
    policy: str = "default",
    columns: Iterable[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``(column, ordinal, type)`` under the named policy.

    ``default``    dates in at least 0.8 of all values, then numbers in more than 0.9
    ``stream``     all rows, numbers must round-trip; numeric above 0.9, else mixed or categorical
    ``head``       first 100 rows: first 5 values dates, then first 10 numeric prefixes
    ``integrity``  first 50 values: dates in 0.8, then numeric prefixes in 0.8
    ``metadata``   numeric prefixes in more than 0.7 of all values, then dates in more than
                   0.8 of the first 100
    ``plan``       first 100 rows: numbers are counted before dates, shares above 0.8
    ``accuracy``   first 20 rows: numeric prefixes in more than 0.8 of the rows

    Fields of structs are columns of their own, with dotted names.  Arrays, maps, booleans,
    intervals and binary cells are none of these types: ``unknown``.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    df = leaves(df)
    picked = cells(df, columns)
    readable = [c for c in picked if c.is_supported]
    others = local_table(df.sparkSession, [(c.name, c.ordinal, "unknown") for c in picked if not c.is_supported], "column string, ordinal int, type string")
    if not readable:
        return others
    found = _RULES[policy](df, readable, order_by)
    return found.unionByName(others) if len(readable) < len(picked) else found


def _number_text(c: Cell) -> Column:
    return loose_number(c.raw) if c.is_text else c.number()


def _stream(df, picked, order_by):
    state = wide(df, picked, summary_aggregates)
    return state.select("column", "ordinal", type_by_share(F.col("numeric_count"), F.col("text_count")).alias("type"))


def _shares(df: DataFrame, picked: Sequence[Cell], number, dated) -> DataFrame:
    return wide(
        df,
        picked,
        lambda c: {
            "rows": F.count(F.lit(1)),
            "filled": F.count_if(~c.missing),
            "numbers": F.count_if(~c.missing & number(c).isNotNull()),
            "dates": F.count_if(~c.missing & dated(c)),
        },
    )


def default_aggregates(c: Cell) -> dict[str, Column]:
    """What the default policy counts of a column."""
    return {
        "rows": F.count(F.lit(1)),
        "filled": F.count_if(~c.missing),
        "numbers": F.count_if(~c.missing & c.number("whole").isNotNull()),
        "dates": F.count_if(~c.missing & c.looks_dated()),
    }


def default_type() -> Column:
    """The default policy's type, from its counts."""
    filled = F.col("filled")
    return (
        F.when(filled == 0, "unknown")
        .when(F.col("dates") >= filled * F.lit(0.8), "temporal")
        .when(F.col("numbers") > filled * F.lit(0.9), "numeric")
        .otherwise("categorical")
    )


def _default(df, picked, order_by):
    return wide(df, picked, default_aggregates).select("column", "ordinal", default_type().alias("type"))


def first_rows(df: DataFrame, n: int, order_by: Sequence[str] | None) -> DataFrame:
    return df.orderBy(*order_by).limit(n) if order_by else df


def _first_values(
    df: DataFrame, picked: Sequence[Cell], n: int, order_by: Sequence[str] | None, month_words: bool = False
) -> DataFrame:
    """``(column, rn, dated, numeric)`` of the first ``n`` values of each column.

    The rank filter is applied in every task before the shuffle.
    """
    order = [f"_o{i}" for i in range(len(order_by or ()))]
    keyed = df.select("*", *[F.col(o).alias(a) for o, a in zip(order_by or (), order)])

    def value(c: Cell) -> Column:
        facts = F.struct(c.looks_dated(month_words).alias("dated"), _number_text(c).isNotNull().alias("numeric"))
        return F.when(~c.missing, facts)

    rows = long(keyed, picked, value, order).where(F.col("value").isNotNull())
    if order_by:
        w = Window.partitionBy("column").orderBy(*order)
        rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    else:
        rows = rows.withColumn("rn", F.lit(0))
    return rows.select("column", "rn", "value.dated", "value.numeric")


def _with_all_columns(found: DataFrame, df: DataFrame, picked: Sequence[Cell], kind: Column) -> DataFrame:
    names = wide(df.limit(1), picked, lambda c: {"_n": F.count(F.lit(1))}).select("column", "ordinal")
    return names.join(F.broadcast(found), "column", "left").select("column", "ordinal", kind.alias("type"))


def _head(df, picked, order_by):
    seen = _first_values(first_rows(df, 100, order_by), picked, 100, order_by, month_words=True)
    found = seen.groupBy("column").agg(
        F.bool_and(F.when(F.col("rn") <= 5, F.col("dated"))).alias("dates"),
        F.bool_and(F.when(F.col("rn") <= 10, F.col("numeric"))).alias("numbers"),
    )
    kind = (
        F.when(F.col("dates").isNull(), "unknown")
        .when(F.col("dates"), "temporal")
        .when(F.col("numbers"), "numeric")
        .otherwise("categorical")
    )
    return _with_all_columns(found, df, picked, kind)


def _integrity(df, picked, order_by):
    found = _first_values(df, picked, 50, order_by).groupBy("column").agg(
        F.avg(F.col("dated").cast("double")).alias("dates"), F.avg(F.col("numeric").cast("double")).alias("numbers")
    )
    kind = (
        F.when(F.col("dates").isNull(), "unknown")
        .when(F.col("dates") >= 0.8, "date")
        .when(F.col("numbers") >= 0.8, "numeric")
        .otherwise("categorical")
    )
    return _with_all_columns(found, df, picked, kind)


def _metadata(df, picked, order_by):
    shares = wide(
        df,
        picked,
        lambda c: {"present": F.count(c.raw), "numbers": F.count(_number_text(c))},
    )
    dated = _first_values(df, picked, 100, order_by).groupBy("column").agg(
        F.avg(F.col("dated").cast("double")).alias("dates")
    )
    kind = (
        F.when(F.col("numbers") > F.col("present") * F.lit(0.7), "numeric")
        .when(F.col("dates") > 0.8, "temporal")
        .otherwise("categorical")
    )
    return shares.join(F.broadcast(dated), "column", "left").select("column", "ordinal", kind.alias("type"))


def _plan(df, picked, order_by):
    def number(c: Cell) -> Column:
        return whole_number(c.raw) if c.is_text else c.number()

    def dated(c: Cell) -> Column:
        parsed = parse_date(c.raw).isNotNull() if c.is_text else F.lit(c.is_time) & c.raw.isNotNull()
        return number(c).isNull() & parsed

    s = _shares(first_rows(df, 100, order_by), picked, number, dated)
    filled = F.col("filled")
    kind = (
        F.when(filled == 0, F.lit(None).cast("string"))
        .when(F.col("dates") > filled * F.lit(0.8), "temporal")
        .when(F.col("numbers") > filled * F.lit(0.8), "numeric")
        .otherwise("categorical")
    )
    return s.select("column", "ordinal", kind.alias("type"))


def _accuracy(df, picked, order_by):
    s = _shares(first_rows(df, 20, order_by), picked, _number_text, lambda c: F.lit(False))
    kind = F.when(F.col("numbers") > F.col("rows") * F.lit(0.8), "numeric").otherwise("categorical")
    return s.select("column", "ordinal", kind.alias("type"))


_RULES = {
    "default": _default,
    "stream": _stream,
    "head": _head,
    "integrity": _integrity,
    "metadata": _metadata,
    "plan": _plan,
    "accuracy": _accuracy,
}


def type_map(df: DataFrame, policy: str = "default", order_by: Sequence[str] | None = None) -> dict[str, str]:
    """Column name to type, for planning (one short string per column)."""
    rows = infer_types(df, policy, order_by=order_by).orderBy("ordinal").collect()
    return {r["column"]: r["type"] for r in rows}


def count_by_type(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


def columns_of_type(types: DataFrame, *wanted: str) -> DataFrame:
    return types.where(F.col("type").isin(list(wanted)))
