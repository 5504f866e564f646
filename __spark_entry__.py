"""Queries over the given tables, and for each the SQL that must agree with it.

``queries()`` runs the library's operators on whole tables.  ``oracle_sql()`` states what
each should return.  Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import operators as ops
from plumbline import plans
from plumbline.functions import scalars as s
from plumbline.operators import columns as shape
from plumbline.plans import charts
from plumbline.sources import table_catalog
from plumbline.streaming import map_batches, run_profile

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = 2026
SEED = 42

LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_COLUMNS = LINE_NUMBERS + ("l_returnflag", "l_linestatus", "l_shipdate")
SHARES = (0.25, 0.5, 0.75)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, ``-0.0`` made ``0.0``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            c = (F.round(c, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# -- derived inputs, the same on both sides ----------------------------------------

# Missing cells, mixed cells and out-of-range cells injected into lineitem.
GAPPY = {
    "l_orderkey": "l_orderkey",
    "l_quantity": "case when l_orderkey % 7 = 0 then null else l_quantity end",
    "l_extendedprice": "case when l_orderkey % 4 = 1 or l_orderkey % 7 = 0 then null else l_extendedprice end",
    "l_tax": "case when l_orderkey % 5 < 3 then null else l_tax end",
    "l_returnflag": "case when l_orderkey % 7 = 0 then '' else l_returnflag end",
    "mixed": "case when l_linenumber % 3 = 0 then 'n/a' when l_linenumber % 3 = 1 then cast(l_linenumber as string) else '2020-01-02' end",
    "discount_rate": "case when l_orderkey % 11 = 0 then 150.0D else l_discount * 100 end",
}
# Health-like columns derived from orders.
HEALTH = {
    "Age": "case when o_orderkey % 50 = 0 then 130 else cast(o_orderkey % 90 as int) end",
    "BMI": "case when o_orderkey % 40 = 0 then 70.5D else 20.0D + o_orderkey % 20 end",
    "total_cholesterol": "case when o_orderkey % 3 = 0 then 5.0D else 180.0D end",
    "systolic_bp": "cast(100 + o_orderkey % 60 as int)",
    "heart_rate": "cast(case when o_orderkey % 25 = 0 then 300 else 60 + o_orderkey % 40 end as int)",
    "Postcode": "case when o_orderkey % 9 = 0 then '12' else cast(1000 + o_orderkey % 9000 as string) end",
    "State": "case o_orderkey % 5 when 0 then 'NSW' when 1 then 'vic' when 2 then 'Queensland' when 3 then 'Oregon' else '' end",
    "diagnosis": "case when o_orderkey % 4 = 0 then 'E11.9' else 'flu' end",
    "weight_lbs": "120.0D + o_orderkey % 50",
    "Year": "cast(case when o_orderkey % 3 = 0 then 2010 when o_orderkey % 3 = 1 then 2012 else 2016 end as int)",
    "o_orderdate": "o_orderdate",
}


def derived(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in spec.items()])


def derived_sql(name: str, spec: Mapping[str, str]) -> str:
    fixed = {n: e.replace(" as string", " as varchar").replace(".0D", ".0::double").replace(".5D", ".5::double") for n, e in spec.items()}
    return "(select " + ", ".join(f'{e} as "{n}"' for n, e in fixed.items()) + f" from {name})"


def gappy(spark, d):
    return derived(table(spark, d, "lineitem"), GAPPY)


def health(spark, d):
    return derived(table(spark, d, "orders"), HEALTH)


GAPPY_SQL = derived_sql("lineitem", GAPPY)
HEALTH_SQL = derived_sql("orders", HEALTH)

# Text cells in many shapes, for the parsing functions.
SHAPES = {
    "k": "o_orderkey",
    "num": "case o_orderkey % 9 when 0 then cast(o_orderkey as string) || 'abc' when 1 then ' ' || cast(o_orderkey as string) || ' '"
    " when 2 then '+5' when 3 then '.5' when 4 then '007' when 5 then '1e3' when 6 then '599.70' when 7 then '' else 'x' || cast(o_orderkey as string) end",
    "day": "case o_orderkey % 7 when 0 then cast(o_orderdate as string) when 1 then substr(cast(o_orderdate as string), 1, 10)"
    " when 2 then '3/14/2015' when 3 then 'Jan 5 2020' when 4 then '2021/7/9' when 5 then '20210709' else 'n/a' end",
    "code": "case o_orderkey % 4 when 0 then 'A00.1' when 1 then 'E11' when 2 then 'flu' else '12345' end",
    "post": "cast(o_orderkey % 12000 as string)",
    "x": "o_totalprice - 200000.0D",
}
SHAPES_SQL = derived_sql("orders", SHAPES)

# -- values that the SQL states for itself -------------------------------------------

# (share in per cent above which it applies, severity, score deduction)
SQL_LADDERS = {
    "missing": ((50.0, "critical", 10), (20.0, "major", 5), (5.0, "minor", 2)),
    "incomplete": ((20.0, "critical", 10), (5.0, "major", 5), (0.0, "minor", 2)),
    "duplicate": ((10.0, "critical", 10), (2.0, "major", 5), (0.0, "minor", 2)),
    "outlier": ((10.0, "major", 5), (2.0, "minor", 2)),
    "health": ((10.0, "major", 5), (0.0, "minor", 2)),
    "any_major": ((0.0, "major", 5),),
    "any_minor": ((0.0, "minor", 2),),
}
SQL_RANGES = {
    "Cholesterol": (2.0, 12.0),
    "Blood_Pressure_Systolic": (70.0, 250.0),
    "Heart_Rate": (30.0, 220.0),
    "Weight_kg": (15.0, 300.0),
    "BMI": (12.0, 60.0),
    "Age": (0.0, 120.0),
}
SQL_STATES = (
    "nsw", "vic", "qld", "sa", "wa", "tas", "nt", "act", "new south wales", "victoria", "queensland",
    "south australia", "western australia", "tasmania", "northern territory", "australian capital territory",
)
# (category, trigger type or None for any, kind, recommendation, priority)
SQL_ADVICE = (
    ("Completeness", None, "issue", "missing_data_handling", "high"),
    ("Consistency", "mixed_types", "issue", "data_type_standardisation", "high"),
    ("Consistency", "duplicate_rows", "issue", "duplicate_removal", "high"),
    ("Accuracy", "outliers", "issue", "outlier_treatment", "medium"),
    ("Accuracy", "extreme_outliers", "issue", "outlier_treatment", "medium"),
    ("Accuracy", "unrealistic_values", "issue", "validate_range_consistency", "high"),
    ("Validity", "invalid_format", "issue", "data_validation", "medium"),
    ("Validity", "invalid_health_measurement", "issue", "clinical_range_validation", "high"),
    ("Timeliness", "outdated_data", "issue", "acquire_recent_data", "high"),
    ("Australian Context", "suspicious_unit", "issue", "standardise_australian_units", "high"),
    ("Australian Context", "incomplete_state_coverage", "warning", "improve_geographical_representation", "medium"),
)

# -- SQL building blocks -------------------------------------------------------------


def each(cols: Sequence[str], fn: Callable[[str, int], str]) -> str:
    return " union all ".join(fn(c, i) for i, c in enumerate(cols))


def cells_sql(source: str, cols: Sequence[str], extra: str = "") -> str:
    """Long form ``("column", ordinal, v)`` of numeric columns."""
    return "(" + each(cols, lambda c, i: f"select '{c}' as \"column\", {i} as ordinal, cast(\"{c}\" as double) as v{extra} from {source}") + ")"


def r(e: str, digits: int = 6) -> str:
    return f"(round({e}, {digits}) + 0.0::double)"


SKEW = "(avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*power(avg(v),3)) / power(var_pop(v), 1.5)"


def centered(source: str, cols: Sequence[str]) -> str:
    """Cells with the column mean beside them, for stable central moments."""
    return f"(select \"column\", ordinal, v, v - avg(v) over (partition by \"column\") as d from {cells_sql(source, cols)} where v is not null)"


def ordered(source: str, cols: Sequence[str]) -> str:
    return (
        f"(select \"column\", ordinal, v, row_number() over (partition by \"column\" order by v) - 1 as i, "
        f"count(*) over (partition by \"column\") as n from {cells_sql(source, cols)} where v is not null)"
    )


def at(p: float) -> str:
    return f"max(case when i = floor(n * {p}) then v end)"


def by(p: float) -> str:
    whole = f"n * {p} = floor(n * {p}) and n % 2 = 0"
    return f"max(case when i = (case when {whole} then floor(n * {p}) - 1 else floor(n * {p}) end) then v end)"


def avg_q(p: float) -> str:
    return f"(({by(p)}) + ({at(p)})) / 2"


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(epoch_us({}) // 1000 % 1000 as varchar), 3, '0') || 'Z'"
STRICT = r"'^(0|-?(0\.\d*[1-9]|[1-9]\d*(\.\d*[1-9])?))$'"
PREFIX = r"'^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)'"
WHOLE = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
LOOSE_SQL = f"try_cast(nullif(regexp_extract({{0}}, {PREFIX}, 1), '') as double)"


def strict_sql(c: str) -> str:
    return f"case when regexp_matches(trim({c}), {STRICT}) then try_cast(trim({c}) as double) end"


def whole_sql(c: str) -> str:
    return f"case when regexp_matches(trim({c}), {WHOLE}) then try_cast(trim({c}) as double) end"


def date_sql(c: str) -> str:
    iso = r"'^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)?$'"
    return (
        f"case when regexp_matches(trim({c}), {iso}) then try_cast(trim({c}) as timestamp) "
        f"when regexp_matches(trim({c}), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then try_strptime(trim({c}), '%m/%d/%Y') "
        f"when regexp_matches(trim({c}), '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}$') then try_strptime(trim({c}), '%Y/%m/%d') "
        f"when regexp_matches(trim({c}), '^[A-Z][a-z]{{2}} \\d{{1,2}} \\d{{4}}$') then try_strptime(trim({c}), '%b %d %Y') end"
    )


def dated_sql(c: str, words: bool = False) -> str:
    more = f" or lower({c}) like '%jan%' or lower({c}) like '%feb%'" if words else ""
    return f"coalesce(({c} like '%-%' or {c} like '%/%' or {c} like '%:%'{more}) and ({date_sql(c)}) is not null, false)"


def summary_sql(source: str, cols: Sequence[str], numbers: Sequence[str]) -> str:
    def one(c, i):
        v = f'"{c}"'
        num = f"cast({v} as double)" if c in numbers else strict_sql(f"cast({v} as varchar)")
        filled = f"({v} is not null and cast({v} as varchar) <> '')"
        return (
            f"select '{c}' as \"column\", {i} as ordinal, count(*) filter ({filled}) as \"count\", "
            f"count(*) filter (not {filled}) as null_count, count({num}) as numeric_count, "
            f"count(*) filter ({filled} and ({num}) is null) as text_count, {r(f'coalesce(sum({num}), 0)', 2)} as \"sum\", "
            f"min({num}) as \"min\", max({num}) as \"max\" from {source}"
        )

    n, c = "numeric_count", '"count"'
    return (
        f"select *, {r('case when numeric_count > 0 then "sum" / numeric_count end', 4)} as mean, "
        f"{r(f'case when {n} > 0 then "sum" / {c} end', 4)} as mean_nonempty, "
        f"case when {c} > 0 and {n}::double / {c} > 0.9 then 'numeric' when {n} > 0 and text_count > 0 then 'mixed' "
        f"else 'categorical' end as data_type from ({each(cols, one)})"
    )


# -- the registry ----------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _ORACLES[name] = sql


def _summaries() -> None:
    register(
        "column_summary",
        lambda sp, d: rounded(ops.column_summary(table(sp, d, "lineitem")), sum=2, mean=4, mean_nonempty=4),
        summary_sql("lineitem", LINE_COLUMNS, LINE_NUMBERS),
    )
    text_cols = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    register(
        "column_summary_text",
        lambda sp, d: rounded(ops.column_summary(as_text(table(sp, d, "orders"))), sum=2, mean=4, mean_nonempty=4),
        summary_sql("orders", text_cols, ()),
    )
    register(
        "column_summary_missing",
        lambda sp, d: rounded(ops.column_summary(gappy(sp, d)), sum=2, mean=4, mean_nonempty=4),
        summary_sql(GAPPY_SQL, list(GAPPY), ("l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "discount_rate")),
    )
    register(
        "overview",
        lambda sp, d: ops.overview(table(sp, d, "lineitem")),
        "select count(*) as row_count, 11::bigint as column_count, 8::bigint as numeric_columns, 3::bigint as text_columns from lineitem",
    )
    register(
        "incremental_profile",
        lambda sp, d: rounded(
            run_profile(
                sp.readStream.schema(table(sp, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d),
                f"profile_{uuid.uuid4().hex}",
            ),
            sum=2, mean=4, mean_nonempty=4,
        ),
        summary_sql("events", ("event_id", "ts", "user_id", "event_type", "value", "props"), ("event_id", "user_id", "value")),
    )
    basic = ("count", "min", "max", "range", "mean", "variance", "standard_deviation")

    def basic_stats(sp, d):
        df = table(sp, d, "lineitem")
        m = ops.moments(df).select("column", *basic)
        q = ops.quantiles(df, shares=(0.5,)).select("column", F.col("quantile").alias("median"))
        return rounded(m.join(F.broadcast(q), "column"), 4, variance=2)

    register(
        "basic_stats",
        basic_stats,
        f"select \"column\", count(v) as \"count\", min(v) as \"min\", max(v) as \"max\", {r('max(v) - min(v)', 4)} as \"range\", "
        f"{r('avg(v)', 4)} as mean, {r('var_pop(v)', 2)} as variance, {r('stddev_pop(v)', 4)} as standard_deviation, "
        f"{r(avg_q(0.5), 4)} as median from {ordered('lineitem', LINE_NUMBERS)} group by \"column\"",
    )
    register(
        "moments",
        lambda sp, d: rounded(
            ops.moments(table(sp, d, "lineitem")).select("column", "count", "skewness", "kurtosis", "appears_normal", "shape")
        ),
        "select \"column\", \"count\", " + r("sk") + " as skewness, " + r("ku") + " as kurtosis, abs(sk) < 0.5 and abs(ku) < 0.5 as appears_normal, "
        "case when sk > 0.5 then 'right-skewed' when sk < -0.5 then 'left-skewed' else 'symmetric' end as shape from ("
        "select \"column\", count(*) as \"count\", avg(d*d*d) / power(avg(d*d), 1.5) as sk, avg(d*d*d*d) / (avg(d*d) * avg(d*d)) - 3 as ku "
        f"from {centered('lineitem', LINE_NUMBERS)} group by \"column\")",
    )
    numeric_sql = (
        "select \"column\", count(*) as \"count\", (select count(*) from lineitem) as \"rows\", "
        f"{r('avg(v)', 4)} as mean, {r('stddev_pop(v)', 4)} as standard_deviation, min(v) as \"min\", max(v) as \"max\", 0.0::double as missing_pct "
        f"from {cells_sql('lineitem', LINE_NUMBERS)} group by \"column\""
    )
    register(
        "numeric_metadata",
        lambda sp, d: rounded(
            plans.numeric_profile(table(sp, d, "lineitem")).select("column", "count", "rows", "mean", "standard_deviation", "min", "max", "missing_pct"), 4
        ),
        numeric_sql,
    )
    kinds = dict.fromkeys(LINE_NUMBERS, "numeric") | {"l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "temporal"}
    flags = ("l_returnflag", "l_linestatus")

    def in_long_form(part: str, rows: DataFrame, named: str | None, keys: Sequence[str]) -> DataFrame:
        """``(part, column, key, value)`` of the given fields; ``named`` is a field that goes into the key."""
        name = F.coalesce(F.col(named).cast("string"), F.lit("")) if named else F.lit("")
        column = F.col("column") if "column" in rows.columns else F.lit("")
        facts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("v")) for k in keys])).alias("x")
        out = rows.select(column.alias("column"), name.alias("name"), facts)
        return out.select(F.lit(part).alias("part"), "column", F.concat_ws(":", "x.k", F.when(F.col("name") != "", F.col("name"))).alias("key"), F.col("x.v").alias("value"))

    def long_parts(got: Mapping[str, DataFrame], picked: Mapping[str, tuple[str | None, Sequence[str]]]) -> DataFrame:
        parts = [in_long_form(p, got[p], named, keys) for p, (named, keys) in picked.items()]
        return rounded(reduce(DataFrame.unionAll, parts), 4)

    def facts_sql(part: str, source: str, facts: Mapping[str, str], by: str = '"column"', name: str = "''") -> str:
        group = f" group by {by}" + (f", {name}" if name != "''" else "") if by != "''" else ""
        return " union all ".join(
            f"select '{part}' as part, {by} as \"column\", '{k}' || case when {name} <> '' then ':' || {name} else '' end as key, {r(f'({e})::double', 4)} as value from {source}{group}"
            for k, e in facts.items()
        )

    numbers_sql = cells_sql("lineitem", LINE_NUMBERS)
    ends = f"(select \"column\" as c, min(v) as lo, max(v) as hi from {numbers_sql} group by 1)"
    bins = (
        f"(select s.c as \"column\", s.b::varchar as bin, count(f.v) as n from (select c, b from {ends}, range(10) t(b)) s left join (select \"column\" as c, v, "
        f"case when v = hi then 9 else least(9, floor((v - lo) / ((hi - lo) / 10.0::double))) end as b from {numbers_sql} join {ends} on c = \"column\") f using (c, b) group by 1, 2)"
    )
    flag_counts = "(" + each(flags, lambda c, i: f"select '{c}' as \"column\", {c} as v, count(*) as n from lineitem group by {c}") + ")"
    days = "(select 'l_shipdate' as \"column\", epoch_ms(l_shipdate::timestamp)::double as v, row_number() over (order by l_shipdate) - 1 as i, count(*) over () as n from lineitem)"
    beyond = f"(select \"column\", {at(0.25)} as q1, {at(0.75)} as q3 from {ordered('lineitem', LINE_NUMBERS)} group by 1)"
    outliers = f"(select \"column\", count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n from {numbers_sql} join {beyond} using (\"column\") group by 1)"
    histogram_facts = facts_sql("histograms", bins, {"count": "sum(n)"}, name="bin")
    register(
        "dataset_stats",
        lambda sp, d: long_parts(
            plans.dataset_stats(table(sp, d, "lineitem"), kinds),
            {
                "moments": (None, ("count", "min", "max", "mean", "range")), "quartiles": (None, ("q1", "q3", "median", "outliers")),
                "histograms": ("bin", ("count",)), "frequencies": ("value", ("count",)), "temporal": (None, ("count", "min_ms", "max_ms", "median")),
            },
        ),
        " union all ".join((
            facts_sql("moments", numbers_sql, {"count": "count(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "range": "max(v) - min(v)"}),
            facts_sql("quartiles", ordered("lineitem", LINE_NUMBERS), {"q1": at(0.25), "q3": at(0.75), "median": avg_q(0.5)}),
            facts_sql("quartiles", outliers, {"outliers": "sum(n)"}),
            histogram_facts,
            facts_sql("frequencies", flag_counts, {"count": "sum(n)"}, name="v"),
            facts_sql("temporal", days, {"count": "count(v)", "min_ms": "min(v)", "max_ms": "max(v)", "median": avg_q(0.5)}),
        )),
    )
    whole_pairs = " union all ".join(
        f"select '{x}' as \"column\", '{y}' as y, " + ("max(1.0::double)" if x == y else f"corr({x}, {y})") + " as v from lineitem" for x in LINE_NUMBERS for y in LINE_NUMBERS
    )
    strong = " union all ".join(
        f"select '{x}' as x, '{y}' as y, corr({x}, {y}) as v from lineitem" for i, x in enumerate(LINE_NUMBERS) for y in LINE_NUMBERS[i + 1 :]
    )
    gap = "(select 'l_shipdate' as \"column\", v, row_number() over (order by v) - 1 as i, count(*) over () as n from (select (v - lag(v) over (order by v)) / 86400000.0::double as v from " + days + ") where v is not null)"
    filled = "(" + each(list(kinds), lambda c, i: f"select '{c}' as \"column\", count(*) - count({c}) as n from lineitem") + ")"

    def metadata_parts(sp, d):
        got = dict(plans.dataset_metadata(table(sp, d, "lineitem"), kinds))
        got["correlations"] = got["correlations"].withColumnRenamed("column_x", "column")
        got["correlated_pairs"] = got["correlated_pairs"].withColumnRenamed("feature1", "column")
        return long_parts(
            got,
            {
                "dataset": (None, ("record_count", "feature_count")), "features": (None, ("missing",)), "numeric_features": (None, ("mean", "variance", "missing_pct")),
                "histograms": ("bin", ("count",)), "correlations": ("column_y", ("correlation",)), "correlated_pairs": ("feature2", ("correlation",)),
                "categorical_features": ("most_frequent", ("valid_count", "unique_values", "most_count")), "value_counts": ("value", ("count", "rank")),
                "temporal_features": (None, ("valid_count", "range_days")), "date_patterns": ("frequency", ("median_days",)),
            },
        )

    most = "(select \"column\", max(v) filter (place = 1) as v, sum(n) as total, count(*) as kinds, max(n) as most from (select *, row_number() over (partition by \"column\" order by n desc, v) as place from " + flag_counts + ") group by 1)"
    register(
        "dataset_metadata",
        metadata_parts,
        " union all ".join((
            facts_sql("dataset", "lineitem", {"record_count": "count(*)", "feature_count": f"max({len(kinds)})"}, by="''"),
            facts_sql("features", filled, {"missing": "sum(n)"}),
            facts_sql("numeric_features", numbers_sql, {"mean": "avg(v)", "variance": "var_pop(v)", "missing_pct": "(count(*) - count(v)) * 100.0 / count(*)"}),
            histogram_facts,
            facts_sql("correlations", f"({whole_pairs})", {"correlation": "sum(v)"}, name="y"),
            f"select 'correlated_pairs', x, 'correlation:' || y, {r('v', 4)} from ({strong}) where abs(v) >= 0.7",
            facts_sql("categorical_features", most, {"valid_count": "sum(total)", "unique_values": "sum(kinds)", "most_count": "sum(most)"}, name="v"),
            facts_sql("value_counts", "(select *, row_number() over (partition by \"column\" order by n desc, v) as place from " + flag_counts + ")", {"count": "sum(n)", "rank": "sum(place)"}, name="v"),
            facts_sql("temporal_features", days, {"valid_count": "count(v)", "range_days": "(max(v) - min(v)) / 86400000.0::double"}),
            f"select 'date_patterns', \"column\", 'median_days:' || case when m < 0.042 then 'sub-hourly' when m < 0.125 then 'hourly' when m < 2.5 then 'daily' else 'other' end, {r('m', 4)} "
            f"from (select \"column\", {avg_q(0.5)} as m from {gap} group by 1)",
        )),
    )
    register(
        "percentage_check",
        lambda sp, d: rounded(ops.percentage_check(table(sp, d, "lineitem")).drop("ordinal"), 2),
        f"select \"column\", {r('sum(v)', 2)} as \"sum\", abs(sum(v) - 100) < 5 or abs(sum(v) - 1) < 0.05 as is_percentage "
        f"from {cells_sql('lineitem', LINE_NUMBERS)} group by \"column\"",
    )
    gap_nums = ("l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "discount_rate")
    register(
        "missing_share_warnings",
        lambda sp, d: rounded(ops.missing_share_warnings(gappy(sp, d))),
        f"select \"column\", missing, {r('pct')} as missing_pct, 'Column \"' || \"column\" || '\" has ' || printf('%.1f', pct) || '% missing values' as message from ("
        f"select \"column\", count(*) - count(v) as missing, (count(*) - count(v)) * 100.0::double / count(*) as pct from {cells_sql(GAPPY_SQL, gap_nums)} group by \"column\") where pct > 20",
    )


def _order() -> None:
    register(
        "order_stats",
        lambda sp, d: ops.order_stats(table(sp, d, "lineitem")),
        "select \"column\", p, cast(floor(n * p) as bigint) as k, v as value from "
        f"{ordered('lineitem', LINE_NUMBERS)}, (values (0.25::double), (0.5::double), (0.75::double)) t(p) where i = floor(n * p)",
    )
    register(
        "quantiles",
        lambda sp, d: rounded(ops.quantiles(table(sp, d, "orders"), ["o_totalprice", "o_orderkey"])),
        each(
            [str(p) for p in SHARES],
            lambda p, _: f"select \"column\", {p}::double as p, {r(avg_q(float(p)))} as quantile from {ordered('orders', ('o_totalprice', 'o_orderkey'))} group by \"column\"",
        ),
    )

    def iqr_sql(source, cols):
        return (
            f"with q as (select \"column\", any_value(n) as n, {at(0.25)} as q1, {at(0.75)} as q3 from {ordered(source, cols)} group by \"column\") "
            f"select q.\"column\", any_value(n) as n, any_value(q1) as q1, any_value(q3) as q3, {r('any_value(q3 - q1)')} as iqr, "
            f"{r('any_value(q1 - 1.5 * (q3 - q1))')} as lower_bound, {r('any_value(q3 + 1.5 * (q3 - q1))')} as upper_bound, "
            f"count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers, "
            f"{r('count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) * 100.0::double / any_value(n)')} as outlier_pct "
            f"from q join {cells_sql(source, cols)} c on q.\"column\" = c.\"column\" where v is not null group by q.\"column\""
        )

    register("iqr_outliers", lambda sp, d: rounded(ops.iqr_outliers(table(sp, d, "lineitem"))), iqr_sql("lineitem", LINE_NUMBERS))
    register(
        "iqr_outliers_documents",
        lambda sp, d: rounded(ops.iqr_outliers(table(sp, d, "documents"), ["n_chars"])),
        iqr_sql("documents", ("n_chars",)),
    )
    register(
        "outlier_values",
        lambda sp, d: ops.outlier_values(table(sp, d, "documents"), "n_chars"),
        f"with q as (select {at(0.25)} as q1, {at(0.75)} as q3 from {ordered('documents', ('n_chars',))}) "
        "select n_chars::double as value, count(*) as \"count\" from documents, q where n_chars < q1 - 1.5 * (q3 - q1) or n_chars > q3 + 1.5 * (q3 - q1) group by n_chars",
    )

    def box_sql(source, cat, val, outliers=False):
        base = (
            f"with c as (select coalesce(cast({cat} as varchar), '') as category, cast({val} as double) as v from {source}), "
            "kept as (select category from c group by category order by count(*) desc, category limit 15), "
            "o as (select category, v, row_number() over (partition by category order by v) - 1 as i, count(*) over (partition by category) as n "
            "from c where v is not null and category in (select category from kept)), "
            f"q as (select category, any_value(n) as n, {at(0.25)} as q1, {at(0.5)} as median, {at(0.75)} as q3, min(v) as lo, max(v) as hi from o group by category), "
            "w as (select *, greatest(lo, q1 - 1.5 * (q3 - q1)) as low, least(hi, q3 + 1.5 * (q3 - q1)) as high from q) "
        )
        if outliers:
            return base + "select o.category, o.v as value, count(*) as \"count\" from o join w using (category) where v < low or v > high group by 1, 2"
        return base + (
            f"select o.category, any_value(w.n) as n, {r('any_value(low)')} as \"min\", any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3, "
            f"{r('any_value(high)')} as \"max\", count(*) filter (v < low or v > high) as outliers from o join w using (category) group by o.category"
        )

    register(
        "boxplot_by_category",
        lambda sp, d: rounded(ops.boxplot(table(sp, d, "lineitem"), "l_extendedprice", "l_returnflag")),
        box_sql("lineitem", "l_returnflag", "l_extendedprice"),
    )
    register(
        "boxplot_many_categories",
        lambda sp, d: rounded(ops.boxplot(table(sp, d, "events"), "value", "user_id")),
        box_sql("events", "user_id", "value"),
    )
    register(
        "boxplot_single",
        lambda sp, d: rounded(ops.boxplot(table(sp, d, "documents"), "n_chars")),
        box_sql("documents", "'n_chars'", "n_chars"),
    )
    register(
        "boxplot_outliers",
        lambda sp, d: ops.boxplot_outliers(table(sp, d, "documents"), "n_chars", "lang"),
        box_sql("documents", "lang", "n_chars", True),
    )


def top_sql(source: str, cols: Sequence[str], top: int, other: str, drop_empty: bool) -> str:
    keep = " and v <> ''" if drop_empty else ""
    long_ = each(cols, lambda c, i: f"select '{c}' as \"column\", cast({c} as varchar) as v from {source}")
    return (
        f"with f as (select \"column\", v as value, count(*) as n from ({long_}) where v is not null{keep} group by all), "
        "k as (select *, row_number() over (partition by \"column\" order by n desc, value) as rn, sum(n) over (partition by \"column\") as total, "
        "count(*) over (partition by \"column\") as uniq from f), "
        f"x as (select \"column\", case when rn <= {top} then value else '{other}' end as value, least(rn, {top + 1}) as \"rank\", sum(n)::bigint as \"count\", "
        "any_value(total)::bigint as column_count, any_value(uniq) as unique_count from k group by all) "
    )


def _frequencies() -> None:
    part_cols = ("p_name", "p_brand", "p_type")
    register(
        "frequency_top20",
        lambda sp, d: ops.frequency(table(sp, d, "part"), part_cols),
        top_sql("part", part_cols, 20, "Other", False) + "select * from x",
    )
    register(
        "categorical_value_counts",
        lambda sp, d: rounded(ops.categorical_value_counts(table(sp, d, "part"), part_cols)),
        top_sql("part", part_cols, 20, "__other__", True)
        + f"select \"column\", value, \"count\", \"rank\", {r('\"count\" * 100.0::double / column_count')} as percentage from x",
    )

    def cat_sql(source, cols):
        def one(c, i):
            return (
                f"select '{c}' as \"column\", any_value(total) as \"count\", coalesce(sum(n), 0)::bigint as valid_count, "
                f"any_value(total) - coalesce(sum(n), 0)::bigint as missing, {r('(any_value(total) - coalesce(sum(n), 0)) * 100.0::double / any_value(total)')} as missing_pct, "
                f"count(*) as unique_values, arg_max(v, r1) as most_frequent, max(n) as most_count, {r('max(n) * 100.0::double / sum(n)')} as most_pct, "
                f"arg_min(v, r1) as least_frequent, min(n) as least_count, {r('min(n) * 100.0::double / sum(n)')} as least_pct from "
                f"(select v, n, (select count(*) from {source}) as total, row_number() over (order by n, v desc) as r1 from "
                f"(select {c} as v, count(*) as n from {source} where {c} is not null and {c} <> '' group by {c}))"
            )

        return each(cols, one)

    register(
        "categorical_profile",
        lambda sp, d: rounded(ops.categorical_profile(table(sp, d, "orders")).drop("ordinal")),
        cat_sql("orders", ("o_orderstatus", "o_orderpriority")),
    )
    register(
        "categorical_profile_missing",
        lambda sp, d: rounded(ops.categorical_profile(gappy(sp, d)).drop("ordinal")),
        cat_sql(GAPPY_SQL, ("l_returnflag", "mixed")),
    )
    register(
        "cardinality",
        lambda sp, d: ops.cardinality(table(sp, d, "part")),
        each(part_cols, lambda c, i: f"select '{c}' as \"column\", count(distinct {c}) as cardinality from part"),
    )
    register(
        "continuity",
        lambda sp, d: ops.continuity(table(sp, d, "lineitem")),
        f"select \"column\", count(v) as n, count(distinct v) as \"distinct\", count(v) >= 10 and count(distinct v) > count(v) * 0.2::double as is_continuous from {cells_sql('lineitem', LINE_NUMBERS)} group by \"column\"",
    )
    register(
        "category_counts",
        lambda sp, d: ops.category_counts(table(sp, d, "documents"), "source"),
        "select source as category, count(*) as \"count\" from documents where source is not null and source <> '' group by source",
    )
    register(
        "distinct_values",
        lambda sp, d: ops.distinct_values(table(sp, d, "pages"), "url"),
        "select distinct url as value from pages where url is not null and url <> ''",
    )

    def hist_sql(cols, bins):
        return (
            f"with c as (select \"column\", v from {cells_sql('lineitem', cols)} where v is not null), "
            f"b as (select \"column\", min(v) as lo, max(v) as hi, count(*) as n, (max(v) - min(v)) / {bins}.0::double as w from c group by \"column\"), "
            f"h as (select \"column\", case when v = hi then {bins - 1} else least(floor((v - lo) / w)::int, {bins - 1}) end as bin, count(*) as cnt from c join b using (\"column\") group by all) "
            f"select b.\"column\", s.bin::int as bin, {r('lo + s.bin * w')} as bin_start, {r('lo + (s.bin + 1) * w')} as bin_end, coalesce(cnt, 0) as \"count\", "
            f"{r('coalesce(cnt, 0) / n::double')} as density, {r('coalesce(cnt, 0) * 100.0::double / n')} as percentage "
            f"from b cross join (select unnest(range({bins})) as bin) s left join h on h.\"column\" = b.\"column\" and h.bin = s.bin"
        )

    register(
        "histogram10",
        lambda sp, d: rounded(ops.histogram(table(sp, d, "lineitem"), LINE_MEASURES)).drop("label"),
        hist_sql(LINE_MEASURES, 10),
    )
    register(
        "histogram20",
        lambda sp, d: rounded(plans.chart_data(table(sp, d, "lineitem"), "histogram", value="l_extendedprice")).drop("label"),
        hist_sql(("l_extendedprice",), 20),
    )


def _time() -> None:
    def profile_sql(t, c):
        return (
            f"select '{c}' as \"column\", count(*) as \"count\", count({c}) as valid_count, count(*) - count({c}) as missing, "
            f"{r(f'(count(*) - count({c})) * 100.0::double / count(*)')} as missing_pct, {ISO.format(f'min({c})', f'min({c})')} as \"min\", "
            f"{ISO.format(f'max({c})', f'max({c})')} as \"max\", {r(f'((epoch_us(max({c})) // 1000) - (epoch_us(min({c})) // 1000)) / 86400000.0::double')} as range_days from {t}"
        )

    def profiles(sp, d):
        parts = [ops.temporal_profile(table(sp, d, t)) for t in ("events", "orders", "lineitem")]
        return rounded(parts[0].unionAll(parts[1]).unionAll(parts[2]))

    register(
        "temporal_profile",
        profiles,
        " union all ".join([profile_sql("events", "ts"), profile_sql("orders", "o_orderdate"), profile_sql("lineitem", "l_shipdate")]),
    )
    ms = "(select (epoch_us(ts) // 1000)::double as v, 'ts' as \"column\", 0 as ordinal from events)"
    ms_ordered = f"(select v, \"column\", row_number() over (order by v) - 1 as i, count(*) over () as n from {ms})"
    register(
        "temporal_stats",
        lambda sp, d: rounded(
            ops.temporal_stats(table(sp, d, "events"))
            .withColumn("mean", F.col("mean") / 1000)
            .withColumns({"variance": F.col("variance") / 1e15, "standard_deviation": F.col("standard_deviation") / 1e6}), 1
        ),
        f"select 'ts' as \"column\", count(*) as \"count\", max(v)::bigint as max_ms, min(v)::bigint as min_ms, (max(v) - min(v))::bigint as \"range\", "
        f"{r('avg(v) / 1000', 1)} as mean, {r('var_pop(v) / 1e15', 1)} as variance, {r('stddev_pop(v) / 1e6', 1)} as standard_deviation, {r(avg_q(0.5), 1)} as median, (select {ISO.format('min(ts)', 'min(ts)')} from events) as min_date, "
        f"(select {ISO.format('max(ts)', 'max(ts)')} from events) as max_date from {ms_ordered}",
    )

    def pattern_sql(t, c):
        ladder = " ".join(f"when days < {limit} then '{name}'" for limit, name in (
            (0.042, "sub-hourly"), (0.125, "hourly"), (2.5, "daily"), (9, "weekly"), (15, "bi-weekly"),
            (45, "monthly"), (135, "quarterly"), (270, "semi-annual"), (450, "annual")))
        return (
            f"select '{c}' as \"column\", case {ladder} else 'irregular' end as frequency, {r('days')} as median_days from "
            f"(select median(gap) / 86400000.0::double as days from (select (epoch_us({c}) // 1000) - lag((epoch_us({c}) // 1000)) over (order by {c}) as gap from {t}))"
        )

    register(
        "date_pattern",
        lambda sp, d: rounded(
            ops.date_pattern(table(sp, d, "events")).unionAll(
                ops.date_pattern(table(sp, d, "orders"))
            )
        ),
        pattern_sql("events", "ts") + " union all " + pattern_sql("orders", "o_orderdate"),
    )
    register(
        "time_gaps",
        lambda sp, d: ops.time_gaps(table(sp, d, "orders"), "o_orderdate"),
        "select v as value, v - lag(v) over (order by v) as gap_ms, n as \"count\" from (select (epoch_us(o_orderdate) // 1000)::double as v, count(*) as n from orders group by 1)",
    )
    days = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

    def share_sql(expr, names, label):
        spine = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))
        return (
            f"select s.{label}, s.name, coalesce(c.n, 0) as \"count\", {r('coalesce(c.n, 0) * 100.0::double / (select count(*) from orders)')} as percentage "
            f"from (values {spine}) s({label}, name) left join (select {expr} as k, count(*) as n from orders group by 1) c on c.k = s.{label}"
        )

    register(
        "weekday_share",
        lambda sp, d: rounded(ops.weekday_share(table(sp, d, "orders"), "o_orderdate")),
        share_sql("dayofweek(o_orderdate) + 1", days, "day"),
    )
    register(
        "month_share",
        lambda sp, d: rounded(ops.month_share(table(sp, d, "orders"), "o_orderdate")),
        share_sql("month(o_orderdate)", months, "month"),
    )
    register(
        "year_gaps",
        lambda sp, d: ops.year_gaps(health(sp, d), "Year"),
        f"select p as from_year, y as to_year from (select y, lag(y) over (order by y) as p from (select distinct \"Year\" as y from {HEALTH_SQL})) where y > p + 1",
    )
    down = (
        "with o as (select {cols}, row_number() over (order by (epoch_us(ts) // 1000), event_id) as rn, count(*) over () as n from events) "
        "select {cols} from o where n <= {k} or (rn - 1) % greatest(1, n // {k}) = 0 or rn = n"
    )
    register(
        "downsample_series",
        lambda sp, d: ops.downsample(table(sp, d, "events").drop("props"), "ts", 1000, "event_id"),
        down.format(cols="event_id, ts, user_id, event_type, value", k=1000),
    )
    # three rows in a thousand share the moment and the tie with others: none may stand for another
    tied = "o_custkey % 3"
    register(
        "downsample_ties",
        lambda sp, d: ops.downsample(
            table(sp, d, "orders").selectExpr("date_trunc('MONTH', o_orderdate) as month", f"{tied} as tie", "o_orderkey"), "month", 700, "tie"
        ).groupBy("month", "tie").agg(F.count("*").alias("picked"), F.countDistinct("o_orderkey").alias("different")),
        f"with o as (select date_trunc('month', o_orderdate)::timestamp as month, {tied} as tie, row_number() over (order by date_trunc('month', o_orderdate), {tied}, o_orderkey) as rn, count(*) over () as n from orders) "
        "select month, tie, count(*) as picked, count(*) as different from o where n <= 700 or (rn - 1) % greatest(1, n // 700) = 0 or rn = n group by all",
    )
    register(
        "chart_line",
        lambda sp, d: plans.chart_data(table(sp, d, "events"), "line", time="ts", values=["value"], tie="event_id", max_points=300),
        down.format(cols="ts, value, event_id", k=300),
    )


def _correlations() -> None:
    def pairs_sql(source, cols):
        return " union all ".join(
            f"select '{a}' as column_x, '{b}' as column_y, count(*) as pairs, {r(f'corr({a}, {b})')} as correlation from {source} where {a} is not null and {b} is not null"
            for i, a in enumerate(cols) for b in cols[i + 1 :]
        )

    def matrix_sql(source, cols):
        half = pairs_sql(source, cols)
        diagonal = each(cols, lambda c, i: f"select '{c}' as column_x, '{c}' as column_y, 1.0::double as correlation")
        return (
            f"with h as ({half}) select column_x, column_y, correlation from h union all select column_y, column_x, correlation from h union all {diagonal}"
        )

    register("pearson_pairs", lambda sp, d: rounded(ops.pearson_pairs(table(sp, d, "lineitem"))), pairs_sql("lineitem", LINE_NUMBERS))
    register(
        "pearson_missing",
        lambda sp, d: rounded(ops.pearson_pairs(gappy(sp, d), ["l_quantity", "l_extendedprice", "l_tax"])),
        pairs_sql(GAPPY_SQL, ("l_quantity", "l_extendedprice", "l_tax")),
    )
    register(
        "pearson_matrix",
        lambda sp, d: rounded(ops.correlation_matrix(table(sp, d, "lineitem"), LINE_MEASURES)),
        matrix_sql("lineitem", LINE_MEASURES),
    )
    register(
        "pearson_constant",
        lambda sp, d: rounded(
            ops.pearson(table(sp, d, "lineitem").select("l_quantity", F.lit(1.0).alias("one")), "l_quantity", "one")
        ),
        "select 'l_quantity' as column_x, 'one' as column_y, count(*) as pairs, null::double as correlation from lineitem",
    )
    register(
        "chart_correlation_matrix",
        lambda sp, d: rounded(plans.chart_data(table(sp, d, "lineitem"), "correlationMatrix", columns=LINE_MEASURES)),
        f"select column_x as x, column_y as y, correlation from ({matrix_sql('lineitem', LINE_MEASURES)})",
    )
    nums = ("p_partkey", "p_size", "p_retailprice")
    register(
        "correlated_pairs",
        lambda sp, d: rounded(ops.correlated_pairs(ops.pearson_pairs(table(sp, d, "part"), nums), 0.01)),
        "select column_x as feature1, column_y as feature2, correlation, case when correlation > 0 then 'positive' else 'negative' end as strength, "
        "case when abs(correlation) > 0.9 then 'very strong' when abs(correlation) > 0.7 then 'strong' else 'moderate' end as magnitude "
        f"from ({pairs_sql('part', nums)}) where abs(correlation) >= 0.01",
    )
    register(
        "dense_matrix",
        lambda sp, d: rounded(ops.dense_matrix(ops.correlation_matrix(table(sp, d, "part"), nums), nums)),
        "select column_x, " + ", ".join(f"max(case when column_y = '{c}' then correlation end) as {c}" for c in nums)
        + f" from ({matrix_sql('part', nums)}) group by column_x",
    )

    def rank_pairs(source, cols):
        out = []
        for i, a in enumerate(cols):
            for b in cols[i + 1 :]:
                ranked = (
                    f"(select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0::double as ra, "
                    f"rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0::double as rb from {source} where {a} is not null and {b} is not null)"
                )
                out.append(f"select '{a}' as column_x, '{b}' as column_y, count(*) as pairs, {r('corr(ra, rb)')} as correlation from {ranked}")
        return " union all ".join(out)

    register("spearman", lambda sp, d: rounded(ops.spearman_pairs(table(sp, d, "lineitem"), LINE_NUMBERS)), rank_pairs("lineitem", LINE_NUMBERS))
    half = rank_pairs("lineitem", LINE_MEASURES)
    register(
        "spearman_matrix",
        lambda sp, d: rounded(ops.correlation_matrix(table(sp, d, "lineitem"), LINE_MEASURES, method="spearman")),
        f"with h as ({half}) select column_x, column_y, correlation from h union all select column_y, column_x, correlation from h union all "
        + " union all ".join(f"select '{c}', '{c}', 1.0::double" for c in LINE_MEASURES),
    )
    # every column with gaps of its own
    holes = {c: f"case when (l_orderkey + {i} * l_linenumber) % {i + 5} = 0 then null else {c} end" for i, c in enumerate(LINE_NUMBERS)}
    register(
        "pearson_many_missing",
        lambda sp, d: rounded(ops.pearson_pairs(derived(table(sp, d, "lineitem"), holes))),
        pairs_sql(derived_sql("lineitem", holes), LINE_NUMBERS),
    )
    register(
        "spearman_many_missing",
        lambda sp, d: rounded(ops.spearman_pairs(derived(table(sp, d, "lineitem"), holes))),
        rank_pairs(derived_sql("lineitem", holes), LINE_NUMBERS),
    )
    register(
        "spearman_missing",
        lambda sp, d: rounded(ops.spearman_pairs(gappy(sp, d), ["l_orderkey", "l_quantity", "l_extendedprice"])),
        rank_pairs(GAPPY_SQL, ("l_orderkey", "l_quantity", "l_extendedprice")),
    )
    register(
        "column_pairs",
        lambda sp, d: ops.column_pairs(ops.infer_types(table(sp, d, "orders"))),
        "with c as (select column_name as c, row_number() over (order by cid) - 1 as o from (select name as column_name, cid from pragma_table_info('orders'))) "
        "select a.c as column_x, b.c as column_y, a.o::int as ord_x, b.o::int as ord_y from c a join c b on a.o < b.o",
    )


def _charts() -> None:
    def avg_sql(source, cat, val):
        return f"select coalesce(cast({cat} as varchar), '') as category, avg({val}) as value from {source} where {val} is not null group by 1"

    def top(inner, k, expr="value"):
        return f"select category, {r(expr)} as value from (select * from ({inner}) order by value desc, category limit {k})"

    line_avg = avg_sql("lineitem", "l_suppkey", "l_extendedprice")
    for kind, k in (("bar", 25), ("horizontalBar", 30)):
        register(
            f"chart_{kind}",
            lambda sp, d, kind=kind: rounded(
                plans.chart_data(table(sp, d, "lineitem"), kind, category="l_suppkey", value="l_extendedprice")
            ),
            top(line_avg, k),
        )
    register(
        "group_average",
        lambda sp, d: rounded(charts.group_average(table(sp, d, "lineitem"), "l_returnflag", "l_quantity")),
        f"select category, {r('value')} as value from ({avg_sql('lineitem', 'l_returnflag', 'l_quantity')})",
    )
    register(
        "chart_pie",
        lambda sp, d: rounded(plans.chart_data(table(sp, d, "part"), "pie", category="p_brand", value="p_retailprice")),
        top(avg_sql("part", "p_brand", "p_retailprice"), 7),
    )
    register(
        "chart_pie_counts",
        lambda sp, d: rounded(plans.chart_data(table(sp, d, "orders"), "pie", category="o_orderpriority", value="count")),
        "select o_orderpriority as category, count(*)::double as value from orders group by 1",
    )
    register(
        "chart_treemap",
        lambda sp, d: rounded(plans.chart_data(table(sp, d, "customer"), "treemap", category="c_nationkey", value="c_acctbal")),
        top(avg_sql("customer", "c_nationkey", "c_acctbal"), 20, "greatest(0, value)"),
    )
    register(
        "crosstab",
        lambda sp, d: plans.chart_data(table(sp, d, "orders"), "heatmap", row="o_orderpriority", column="o_orderstatus"),
        "with p as (select o_orderpriority as r, o_orderstatus as c, count(*) as n from orders group by 1, 2) "
        "select x.r as \"row\", y.c as \"column\", coalesce(p.n, 0) as \"count\" from (select distinct r from p) x cross join (select distinct c from p) y left join p on p.r = x.r and p.c = y.c",
    )
    register(
        "crosstab_many",
        lambda sp, d: plans.chart_data(table(sp, d, "part"), "heatmap", row="p_name", column="p_brand"),
        "with p as (select p_name as r, p_brand as c, count(*) as n from part group by 1, 2), "
        "x as (select r from p group by r order by sum(n) desc, r limit 20), y as (select c from p group by c order by sum(n) desc, c limit 20) "
        "select x.r as \"row\", y.c as \"column\", coalesce(p.n, 0) as \"count\" from x cross join y left join p on p.r = x.r and p.c = y.c",
    )
    picked = "select {cols} from (select * from {t} order by md5(cast({k} as varchar) || '|{seed}'), {k} limit {n})"
    register(
        "chart_scatter",
        lambda sp, d: plans.chart_data(table(sp, d, "orders"), "scatter", x="o_custkey", y="o_totalprice", key=["o_orderkey"], seed=SEED),
        picked.format(cols="o_custkey, o_totalprice", t="orders", k="o_orderkey", seed=SEED, n=2000),
    )
    register(
        "chart_bubble",
        lambda sp, d: plans.chart_data(
            table(sp, d, "orders"), "bubble", x="o_custkey", y="o_totalprice", size="o_orderkey", key=["o_orderkey"], seed=SEED
        ),
        picked.format(cols="o_custkey, o_totalprice, o_orderkey", t="orders", k="o_orderkey", seed=SEED, n=1000),
    )
    register(
        "chart_table",
        lambda sp, d: plans.chart_data(table(sp, d, "nation"), "table", columns=["n_name", "n_regionkey"]),
        "select n_name, n_regionkey from nation",
    )
    register(
        "excluded_rows",
        lambda sp, d: charts.excluded_rows(gappy(sp, d), "l_returnflag", "mixed"),
        f"select count(*) as \"rows\", count(*) filter (l_returnflag is null or l_returnflag = '' or (mixed is not null and {LOOSE_SQL.format('mixed')} is null)) as invalid_rows from {GAPPY_SQL}",
    )
    register(
        "sample_exact",
        lambda sp, d: ops.random_sample(table(sp, d, "orders"), 100, ["o_orderkey"], SEED),
        picked.format(cols="*", t="orders", k="o_orderkey", seed=SEED, n=100),
    )

    register(
        "sample_reservoir",
        lambda sp, d: ops.reservoir_sample(table(sp, d, "customer"), 150, ["c_custkey"], SEED),
        picked.format(cols="*", t="customer", k="c_custkey", seed=SEED, n=150),
    )

    def strat_sql(t, col, key, k):
        return (
            f"with h as (select *, md5(cast({key} as varchar) || '|{SEED}') as h, count(*) over (partition by {col}) as sc, count(*) over () as tc from {t}), "
            f"q as (select *, row_number() over (partition by {col} order by h, {key}) as rn, greatest(1, floor({k}.0::double * sc / tc + 0.5)) as quota from h) "
            f"select * exclude (h, sc, tc, rn, quota) from q where rn <= quota order by md5(h || 'trim'), {key} limit {k}"
        )

    register(
        "sample_stratified",
        lambda sp, d: ops.stratified_sample(table(sp, d, "orders"), "o_orderpriority", 500, ["o_orderkey"], SEED),
        strat_sql("orders", "o_orderpriority", "o_orderkey", 500),
    )
    register(
        "sample_adaptive",
        lambda sp, d: ops.adaptive_sample(
            table(sp, d, "part"), {"p_brand": "categorical", "p_name": "categorical", "p_size": "numeric"}, 300, ["p_partkey"], SEED
        ),
        strat_sql("part", "p_name", "p_partkey", 300),
    )


def _quality() -> None:
    gap_cols = list(GAPPY)

    def missing_sql():
        def one(c, i):
            empty = f"\"{c}\" is null or cast(\"{c}\" as varchar) = ''"
            return f"select '{c}' as \"column\", count(*) filter ({empty}) as affected, count(*) filter ({empty}) * 100.0::double / count(*) as p from {GAPPY_SQL}"

        return (
            f"select \"column\", case when p > 50 then 'critical' when p > 20 then 'major' else 'minor' end as severity, affected, {r('p')} as pct, "
            f"case when p > 50 then 10 when p > 20 then 5 else 2 end as deduction from ({each(gap_cols, one)}) where p > 5"
        )

    found = ("column", "severity", "affected", "pct", "deduction")
    register("missing_by_column", lambda sp, d: rounded(ops.missing_by_column(gappy(sp, d)).select(*found)), missing_sql())
    empty_cells = " + ".join(f"(\"{c}\" is null or cast(\"{c}\" as varchar) = '')::int" for c in gap_cols)

    def ladder_sql(steps, p="p"):
        sev = "case " + " ".join(f"when {p} > {x} then '{s_}'" for x, s_, _ in steps) + " end"
        ded = "case " + " ".join(f"when {p} > {x} then {n}" for x, _, n in steps) + " end"
        return f"{sev} as severity, {ded} as deduction"

    register(
        "incomplete_rows",
        lambda sp, d: rounded(ops.incomplete_rows(gappy(sp, d)).select("severity", "affected", "pct", "deduction")),
        f"select {ladder_sql(SQL_LADDERS['incomplete'])}, affected, {r('p')} as pct from (select count(*) filter (e > {len(gap_cols)} * 0.5) as affected, "
        f"count(*) filter (e > {len(gap_cols)} * 0.5) * 100.0::double / count(*) as p from (select {empty_cells} as e from {GAPPY_SQL})) where affected > 0",
    )
    register(
        "mixed_types",
        lambda sp, d: rounded(ops.mixed_types(gappy(sp, d)).select(*found)),
        f"with c as (select count(*) filter (({whole_sql('mixed')}) is not null) as n, count(*) filter (({whole_sql('mixed')}) is null and {dated_sql('mixed')}) as dt, count(*) as a from {GAPPY_SQL}) "
        f"select 'mixed' as \"column\", 'major' as severity, a - greatest(n, dt, a - n - dt) as affected, {r('(a - greatest(n, dt, a - n - dt)) * 100.0::double / a')} as pct, 5 as deduction from c",
    )
    dup_cols = "o_orderstatus, o_orderpriority, o_orderdate"
    dup = lambda sp, d: table(sp, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate")
    register(
        "duplicate_groups",
        lambda sp, d: ops.duplicate_groups(dup(sp, d)),
        f"select {dup_cols}, count(*) as copies from orders group by all having count(*) > 1",
    )
    register(
        "duplicate_rows",
        lambda sp, d: ops.duplicate_rows(dup(sp, d)),
        f"select * from (select {dup_cols}, row_number() over (partition by {dup_cols}) as occurrence from orders) where occurrence > 1",
    )
    # a third of all rows made equal
    hot = {c: f"case when l_orderkey % 3 = 0 then {'0' if c != 'l_returnflag' else repr('A')} else {c} end" for c in ("l_orderkey", "l_linenumber", "l_returnflag")}
    register(
        "duplicate_hot_row",
        lambda sp, d: ops.duplicate_groups(derived(table(sp, d, "lineitem"), hot)),
        f"select *, count(*) as copies from {derived_sql('lineitem', hot)} group by all having count(*) > 1",
    )
    register(
        "duplicate_count",
        lambda sp, d: rounded(ops.duplicate_count(table(sp, d, "documents").select("text", "lang"))),
        f"select count(*) as \"rows\", count(*) - (select count(*) from (select distinct text, lang from documents)) as duplicates, "
        f"{r('(count(*) - (select count(*) from (select distinct text, lang from documents))) * 100.0::double / count(*)')} as pct from documents",
    )
    limits = (("l_discount", 0.02, 0.08), ("l_quantity", 1, 50), ("l_tax", 0.0, 0.05))
    register(
        "range_rules",
        lambda sp, d: rounded(ops.range_checks(table(sp, d, "lineitem"), limits).select(*found)),
        "select \"column\", 'major' as severity, affected, " + r("affected * 100.0::double / n") + " as pct, 5 as deduction from ("
        + " union all ".join(
            f"select '{c}' as \"column\", count(*) filter ({c} < {lo}::double or {c} > {hi}::double) as affected, count(*) as n from lineitem" for c, lo, hi in limits
        )
        + ") where affected > 0",
    )

    def aged(c, y):
        return f"select '{c}' as \"column\", {AS_OF} - max({y}) as age from {HEALTH_SQL}"

    timed = (
        "select \"column\", case when age > 5 then 'issue' else 'warning' end as kind, case when age > 10 then 'critical' when age > 5 then 'major' else 'minor' end as severity, "
        "case when age > 10 then 10 when age > 5 then 5 else 2 end as deduction, 'The newest value is ' || age || ' years old (' || "
        f"({AS_OF} - age) || ')' as description from (" + aged("Year", '"Year"') + " union all " + aged("o_orderdate", "year(o_orderdate)") + ") where age > 2"
    )
    register(
        "timeliness",
        lambda sp, d: ops.timeliness(health(sp, d), AS_OF).select("column", "kind", "severity", "deduction", "description"),
        timed,
    )
    states = ", ".join(f"'{x}'" for x in SQL_STATES)
    inside = f"lower(v) in ({states})"
    state_values = f"(select distinct \"State\" as v from {HEALTH_SQL} where \"State\" is not null and \"State\" <> '')"
    register(
        "domain_coverage",
        lambda sp, d: ops.domain_coverage(health(sp, d), ["State"]),
        f"select 'State' as \"column\", count(*) filter ({inside}) as inside, count(*) filter (not {inside}) as outside, "
        f"count(*) filter ({inside}) between 1 and 7 as incomplete from {state_values}",
    )
    nations = lambda sp, d: table(sp, d, "nation").where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("value"))

    def nation_names(sp, d):
        c = table(sp, d, "customer")
        return c.select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("nation"))

    for name, fn, neg in (("domain_violations", ops.domain_violations, "not "), ("domain_matches", ops.domain_matches, "")):
        register(
            name,
            lambda sp, d, fn=fn: fn(nation_names(sp, d), "nation", nations(sp, d)),
            "select distinct 'nation_' || c_nationkey as value from customer where lower('nation_' || c_nationkey) "
            f"{neg}in (select lower(n_name) from nation where n_nationkey % 2 = 0)",
        )

    # the whole report on the health table
    wide_found = ("category", "kind", "column", "type", "severity", "affected", "pct", "deduction")

    def health_issues(sp, d):
        return ops.issues(health(sp, d), AS_OF)

    def counted(category, kind, column, type_, cond, steps, whole="count(*)"):
        return (
            f"select '{category}' as category, '{kind}' as kind, {column} as \"column\", '{type_}' as type, {ladder_sql(steps)}, affected, {r('p')} as pct from "
            f"(select count(*) filter ({cond}) as affected, count(*) filter ({cond}) * 100.0::double / {whole} as p from {HEALTH_SQL}) where affected > 0"
        )

    def outlier_issue(c, steps=SQL_LADDERS["outlier"], reach=1.5):
        src = ordered(HEALTH_SQL, (c,))
        cond = f"v < q1 - {reach} * (q3 - q1) or v > q3 + {reach} * (q3 - q1)"
        return (
            f"select 'Accuracy' as category, 'issue' as kind, '{c}' as \"column\", case when p > {steps[0][0]} then 'extreme_outliers' else 'outliers' end as type, "
            f"{ladder_sql(steps)}, affected, {r('p')} as pct from (select count(*) filter ({cond}) as affected, count(*) filter ({cond}) * 100.0::double / count(*) as p "
            f"from {cells_sql(HEALTH_SQL, (c,))}, (select {at(0.25)} as q1, {at(0.75)} as q3 from {src})) where affected > 0"
        )

    def m_range(name):
        low, high = SQL_RANGES[name]
        return lambda c: f"\"{c}\" < {low} or \"{c}\" > {high}"

    all_cols = list(HEALTH)
    nulls = [f"(\"{c}\" is null or cast(\"{c}\" as varchar) = '')" for c in all_cols]
    quoted = ", ".join(f'"{c}"' for c in all_cols)
    dup_n = f"(select count(*) - (select count(*) from (select distinct {quoted} from {HEALTH_SQL})) as affected, count(*) as n from {HEALTH_SQL})"
    report = [
        *[counted("Completeness", "issue", f"'{c}'", "missing_values", e, SQL_LADDERS['missing']) for c, e in zip(all_cols, nulls)],
        counted("Completeness", "issue", "null", "incomplete_rows", " + ".join(f"{e}::int" for e in nulls) + f" > {len(all_cols)} * 0.5", SQL_LADDERS['incomplete']),
        counted("Consistency", "issue", "'heart_rate'", "logical_inconsistency", "heart_rate > 100", SQL_LADDERS['any_major']),
        *[outlier_issue(c) for c in ("Age", "BMI", "total_cholesterol", "systolic_bp", "heart_rate", "Postcode", "weight_lbs", "Year")],
        counted("Accuracy", "issue", "'BMI'", "unrealistic_values", m_range("BMI")("BMI"), SQL_LADDERS['any_major']),
        counted("Accuracy", "issue", "'Age'", "unrealistic_values", m_range("Age")("Age"), SQL_LADDERS['any_major']),
        counted("Validity", "issue", "'Postcode'", "invalid_format", "not regexp_matches(\"Postcode\", '^\\d{4}$')", SQL_LADDERS['any_minor']),
        counted("Validity", "issue", "'total_cholesterol'", "invalid_health_measurement", m_range("Cholesterol")("total_cholesterol"), SQL_LADDERS['health']),
        counted("Validity", "issue", "'systolic_bp'", "invalid_health_measurement", m_range("Blood_Pressure_Systolic")("systolic_bp"), SQL_LADDERS['health']),
        counted("Validity", "issue", "'heart_rate'", "invalid_health_measurement", m_range("Heart_Rate")("heart_rate"), SQL_LADDERS['health']),
        counted("Validity", "issue", "'weight_lbs'", "invalid_health_measurement", m_range("Weight_kg")("weight_lbs"), SQL_LADDERS['health']),
        counted("Australian Context", "issue", "'total_cholesterol'", "suspicious_unit", "total_cholesterol > 50", ((50.0, "major", 5),)),
        counted("Australian Context", "warning", "'diagnosis'", "non_standard_classification", "not regexp_matches(diagnosis, '^[A-Z]\\d\\d(\\.\\d)?$')", ((50.0, "minor", 1),)),
        f"select 'Consistency', 'issue', null, 'duplicate_rows', {ladder_sql(SQL_LADDERS['duplicate'])}, affected, {r('p')} from (select affected, affected * 100.0::double / n as p from {dup_n}) where affected > 0",
        f"select 'Consistency', 'warning', 'Year', 'chronological_gaps', 'minor', 1, count(*), null::double from (select y, lag(y) over (order by y) as p from (select distinct \"Year\" as y from {HEALTH_SQL})) where y > p + 1 having count(*) > 0",
        f"select 'Timeliness', kind, \"column\", 'outdated_data', severity, deduction, null::bigint, null::double from ({timed})",
        f"select 'Australian Context', 'warning', 'State', 'non_australian_states', 'minor', 2, n, null::double from (select count(*) filter (not {inside}) as n from {state_values}) where n > 0",
        f"select 'Australian Context', 'warning', 'State', 'incomplete_state_coverage', 'minor', 1, n, null::double from (select count(*) filter ({inside}) as n from {state_values}) where n between 1 and 7",
        "select 'Australian Context', 'warning', 'weight_lbs', 'non_australian_unit', 'minor', 1, null::bigint, null::double",
    ]
    report_sql = "(" + " union all ".join(report) + ")"
    issues_sql = f"select category, kind, \"column\", type, severity, affected, pct, deduction from {report_sql} where severity is not null"
    register("quality_issues", lambda sp, d: rounded(health_issues(sp, d).select(*wide_found)), issues_sql)
    # other thresholds, ranges and deductions than the default ones
    own = {
        "missing": ((15.0, "critical", 7), (1.0, "minor", 3)),
        "outlier": ((30.0, "major", 9), (1.0, "minor", 4)),
        "health": ((0.0, "critical", 8),),
        "any_major": ((1.5, "major", 6), (0.0, "minor", 2)),
    }
    custom = ops.Rules(
        missing=own["missing"], outliers=own["outlier"], health=own["health"], any_major=own["any_major"], fence=3.0, share_limit=250.0,
        measurements=(ops.Measurement("Cholesterol", 4.0, 100.0, ("cholesterol",)), ops.Measurement("Heart_Rate", 65.0, 310.0, ("heart_rate",))),
        person_ranges=(ops.Measurement("BMI", 22.0, 80.0, ("BMI",)),), states=("NSW", "Oregon"), state_count=3, state_deductions=(5, 4),
        ages=((4, "warning", "minor", 3),), duplicates=((0.0, "minor", 1),), year_deduction=6, unit_value_limit=1000.0, diagnoses=((5.0, "minor", 2),),
        any_minor=((50.0, "minor", 9),), units=(), incomplete_share=0.05, incomplete=((0.0, "major", 11),),
    )
    own_in = "lower(v) in ('nsw', 'oregon')"
    custom_rows = [
        *[counted("Completeness", "issue", f"'{c}'", "missing_values", e, own["missing"]) for c, e in zip(all_cols, nulls)],
        counted("Completeness", "issue", "null", "incomplete_rows", " + ".join(f"{e}::int" for e in nulls) + f" > {len(all_cols)} * 0.05", ((0.0, "major", 11),)),
        counted("Consistency", "issue", "'heart_rate'", "logical_inconsistency", "heart_rate > 250", own["any_major"]),
        *[outlier_issue(c, own["outlier"], 3.0) for c in ("Age", "BMI", "total_cholesterol", "systolic_bp", "heart_rate", "Postcode", "weight_lbs", "Year")],
        counted("Accuracy", "issue", "'BMI'", "unrealistic_values", '"BMI" < 22 or "BMI" > 80', own["any_major"]),
        counted("Validity", "issue", "'total_cholesterol'", "invalid_health_measurement", "total_cholesterol < 4 or total_cholesterol > 100", own["health"]),
        counted("Validity", "issue", "'heart_rate'", "invalid_health_measurement", "heart_rate < 65 or heart_rate > 310", own["health"]),
        counted("Validity", "issue", "'Postcode'", "invalid_format", "not regexp_matches(\"Postcode\", '^\\d{4}$')", ((50.0, "minor", 9),)),
        counted("Australian Context", "warning", "'diagnosis'", "non_standard_classification", "not regexp_matches(diagnosis, '^[A-Z]\\d\\d(\\.\\d)?$')", ((5.0, "minor", 2),)),
        f"select 'Consistency', 'issue', null, 'duplicate_rows', {ladder_sql(((0.0, 'minor', 1),))}, affected, {r('p')} from (select affected, affected * 100.0::double / n as p from {dup_n}) where affected > 0",
        f"select 'Consistency', 'warning', 'Year', 'chronological_gaps', 'minor', 6, count(*), null::double from (select y, lag(y) over (order by y) as p from (select distinct \"Year\" as y from {HEALTH_SQL})) where y > p + 1 having count(*) > 0",
        "select 'Timeliness', 'warning', \"column\", 'outdated_data', 'minor', 3, null::bigint, null::double from (" + aged("Year", '"Year"') + " union all " + aged("o_orderdate", "year(o_orderdate)") + ") where age > 4",
        f"select 'Australian Context', 'warning', 'State', 'non_australian_states', 'minor', 5, n, null::double from (select count(*) filter (not {own_in}) as n from {state_values}) where n > 0",
        f"select 'Australian Context', 'warning', 'State', 'incomplete_state_coverage', 'minor', 4, n, null::double from (select count(*) filter ({own_in}) as n from {state_values}) where n between 1 and 2",
    ]
    register(
        "quality_custom_rules",
        lambda sp, d: rounded(ops.issues(health(sp, d), AS_OF, rule=custom).select(*wide_found)),
        f"select category, kind, \"column\", type, severity, affected, pct, deduction from ({' union all '.join(custom_rows)}) where severity is not null",
    )
    score = (
        f"select (select count(*) from orders) as total_records, {len(all_cols)} as total_columns, "
        + ", ".join(f"count(*) filter (kind = 'issue' and severity = '{x}') as {x}_issues" for x in ("critical", "major", "minor"))
        + f", count(*) filter (kind = 'warning') as warnings, greatest(0, 100 - sum(deduction))::bigint as score from ({issues_sql})"
    )
    register(
        "quality_score",
        lambda sp, d: ops.score_summary(health(sp, d), shape.settle(health_issues(sp, d))),
        f"select *, case when score < 30 then 'critical' when score < 60 then 'poor' when score < 80 then 'fair' when score < 95 then 'good' else 'excellent' end as rating from ({score})",
    )
    advice = ", ".join(
        "(" + ", ".join("null" if x is None else f"'{x}'" for x in a) + ")" for a in SQL_ADVICE
    )
    register(
        "quality_recommendations",
        lambda sp, d: ops.recommendations(shape.settle(health_issues(sp, d))).drop("description"),
        f"with f as ({issues_sql}) select distinct a.category, a.advice as type, a.priority from (values {advice}) a(category, tr, kind, advice, priority) "
        "join f on f.category = a.category and f.kind = a.kind and (a.tr is null or a.tr = f.type)",
    )
    register(
        "format_recommendations",
        lambda sp, d: ops.format_recommendations(
            shape.settle(ops.infer_types(health(sp, d), "integrity")), shape.settle(health_issues(sp, d))
        ).withColumn("columns", F.array_join("columns", ",")),
        "select 'data_structure' as type, 'high' as priority, null as columns union all select 'date_format', 'medium', 'o_orderdate' "
        f"union all select 'missing_values', 'high', string_agg(\"column\", ',') from ({issues_sql}) where type = 'missing_values' having count(*) > 0 "
        "union all select 'numeric_format', 'medium', 'Age,BMI,total_cholesterol,systolic_bp,heart_rate,Postcode,weight_lbs,Year'",
    )
    register(
        "union_findings",
        lambda sp, d: rounded(
            ops.union_findings(
                {"gaps": ops.missing_by_column(gappy(sp, d)).select("column", "affected"), "limits": ops.range_checks(table(sp, d, "lineitem"), limits).select("column", "affected")}
            )
        ),
        f"select \"column\", affected, 'gaps' as category from ({missing_sql()}) union all select * from ("
        + " union all ".join(
            f"select '{c}' as \"column\", count(*) filter ({c} < {lo}::double or {c} > {hi}::double) as affected, 'limits' as category from lineitem" for c, lo, hi in limits
        )
        + ") where affected > 0",
    )


def _reconcile() -> None:
    def rec_sql(a, ka, b, kb, name):
        return (
            f"with l as (select {ka} as k, count(*) as n from {a} group by 1), r as (select {kb} as k, count(*) as n from {b} group by 1) "
            f"select * from (select coalesce(l.k, r.k) as {name}, coalesce(l.n, 0) as left_count, coalesce(r.n, 0) as right_count, case when r.n is null then 'missing' "
            "when l.n is null then 'orphaned' when l.n <> r.n then 'mismatch' end as finding from l full join r on l.k = r.k) where finding is not null"
        )

    register(
        "reconcile",
        lambda sp, d: ops.reconcile(table(sp, d, "documents"), table(sp, d, "labels"), ["doc_id"]),
        rec_sql("documents", "doc_id", "labels", "doc_id", "doc_id"),
    )
    # keys with nulls on both sides, in one column of two
    left = {"a": "case when o_orderkey % 5 = 0 then null else o_orderkey % 40 end", "b": "o_orderstatus"}
    right = {"a": "case when o_orderkey % 7 = 0 then null else o_orderkey % 50 end", "b": "case when o_orderkey % 3 = 0 then null else o_orderstatus end"}
    register(
        "reconcile_null_keys",
        lambda sp, d: ops.reconcile(derived(table(sp, d, "orders"), left), derived(table(sp, d, "orders"), right), ["a", "b"]),
        f"with l as (select a, b, count(*) as n from {derived_sql('orders', left)} group by a, b), r as (select a, b, count(*) as n from {derived_sql('orders', right)} group by a, b) "
        "select * from (select coalesce(l.a, r.a) as a, coalesce(l.b, r.b) as b, coalesce(l.n, 0) as left_count, coalesce(r.n, 0) as right_count, case when r.n is null then 'missing' "
        "when l.n is null then 'orphaned' when l.n <> r.n then 'mismatch' end as finding from l full join r on l.a is not distinct from r.a and l.b is not distinct from r.b) where finding is not null",
    )
    register(
        "reconcile_summary",
        lambda sp, d: ops.reconcile_summary(
            table(sp, d, "orders").select(F.col("o_orderkey").alias("k")), table(sp, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"]
        ),
        f"select finding, count(*) as keys from ({rec_sql('orders', 'o_orderkey', 'lineitem', 'l_orderkey', 'k')}) group by finding",
    )
    register(
        "new_rows",
        lambda sp, d: ops.new_rows(table(sp, d, "documents"), table(sp, d, "labels"), ["doc_id"]).select("doc_id", "lang"),
        "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    )
    record = {
        "id": "case when o_orderkey % 97 = 0 then null else o_orderkey end",
        "path": "case when o_orderkey % 13 = 0 then '' else '/data/' || cast(o_orderkey as string) end",
        "status": "case o_orderkey % 4 when 0 then 'ready' when 1 then 'processing' when 2 then 'lost' else 'error' end",
        "sample_rows": "case o_orderkey % 3 when 0 then null when 1 then 0 else 100 end",
        "row_count": "case when o_orderkey % 5 = 0 then null else o_orderkey end",
        "column_count": "case when o_orderkey % 10 = 0 or o_orderkey % 6 = 0 then null else 5 end",
    }
    record_sql = derived_sql("orders", record)
    checks = (
        ("missing_property", "high", "id", "id is null"),
        ("missing_property", "high", "path", "path = ''"),
        ("invalid_status", "medium", "status", "status not in ('ready', 'processing', 'error')"),
        ("missing_sample", "high", "sample", "status = 'ready' and sample_rows is null"),
        ("empty_sample", "high", "sample", "status = 'ready' and sample_rows = 0"),
        ("missing_summary", "medium", "summary", "status = 'ready' and row_count is null and column_count is null"),
        ("invalid_summary", "medium", "columns", "status = 'ready' and row_count is not null and column_count is null"),
        ("invalid_summary", "medium", "row_count", "status = 'ready' and row_count is null and column_count is not null"),
    )
    register(
        "validate_records",
        lambda sp, d: ops.validate_datasets(derived(table(sp, d, "orders"), record)),
        " union all ".join(
            f"select id as \"key\", '{t}' as type, '{sv}' as severity, '{dt}' as detail from {record_sql} where {cond}" for t, sv, dt, cond in checks
        ),
    )
    names = ("nation", "orders", "events", "documents")
    register(
        "table_catalog",
        lambda sp, d: table_catalog({n: table(sp, d, n) for n in names}),
        each(names, lambda t, i: f"select '{t}' as name, 'ready' as status, count(*) as row_count, (select count(*) from pragma_table_info('{t}'))::int as column_count from {t}"),
    )
    register(
        "map_batches",
        lambda sp, d: map_batches(
            table(sp, d, "orders").select("o_orderkey", "o_totalprice"), lambda p: p.assign(cents=(p.o_totalprice * 100).round().astype("int64"))[["o_orderkey", "cents"]],
            "o_orderkey bigint, cents bigint",
        ),
        "select o_orderkey, round(o_totalprice * 100)::bigint as cents from orders",
    )


def _parsing() -> None:
    register(
        "parse_numbers",
        lambda sp, d: derived(table(sp, d, "orders"), SHAPES).select(
            "k", s.strict_number(F.col("num")).alias("strict"), s.loose_number(F.col("num")).alias("loose"),
            s.whole_number(F.col("num")).alias("whole"), s.is_missing(F.col("num")).alias("missing"), s.frequency_key(F.col("k")).alias("key"),
        ),
        f"select k, {strict_sql('num')} as strict, {LOOSE_SQL.format('num')} as loose, {whole_sql('num')} as whole, num is null or num = '' as missing, cast(k as varchar) as \"key\" from {SHAPES_SQL}",
    )
    parsed = f"({date_sql('day')})"
    register(
        "parse_dates",
        lambda sp, d: derived(table(sp, d, "orders"), SHAPES).select(
            "k", s.is_date(F.col("day")).alias("is_date"), s.is_date(F.col("day"), True).alias("is_date_or_month"),
            s.epoch_ms(s.parse_date(F.col("day"))).alias("ms"), s.iso_text(s.epoch_ms(s.parse_date(F.col("day")))).alias("iso"),
            s.year_of(F.col("day")).alias("year"), s.weekday(s.parse_date(F.col("day"))).alias("weekday"), s.month_of(s.parse_date(F.col("day"))).alias("month"),
            s.integer_prefix(F.col("day")).alias("int_prefix"),
        ),
        f"select k, {dated_sql('day')} as is_date, {dated_sql('day', True)} as is_date_or_month, (epoch_us({parsed}) // 1000) as ms, {ISO.format(parsed, parsed)} as iso, year({parsed})::int as \"year\", "
        f"(dayofweek({parsed}) + 1)::int as weekday, month({parsed})::int as \"month\", try_cast(nullif(regexp_extract(day, '^\\s*([+-]?\\d+)', 1), '') as int) as int_prefix from {SHAPES_SQL}",
    )
    register(
        "cell_patterns",
        lambda sp, d: derived(table(sp, d, "orders"), SHAPES).select(
            "k", s.is_postcode(F.col("post")).alias("postcode"), s.is_icd10(F.col("code")).alias("icd10"), s.in_domain(F.col("code"), ["E11", "a00.1"]).alias("member"),
            s.clamp_non_negative(F.col("x")).alias("clamped"), s.bin_label(F.floor("x").cast("double"), F.floor("x").cast("double") + 1).alias("label"),
            s.percent_text(s.percent(F.col("k") % 7, F.lit(8)), 1).alias("share"), s.round_half_up(F.col("x")).alias("nearest"),
        ),
        f"select k, regexp_matches(post, '^\\d{{4}}$') as postcode, regexp_matches(code, '^[A-Z]\\d\\d(\\.\\d)?$') as icd10, lower(code) in ('e11', 'a00.1') as member, greatest(0, x) as clamped, "
        f"printf('%.2f - %.2f', floor(x), floor(x) + 1) as label, printf('%.1f', (k % 7) * 100.0::double / 8) as share, floor(x + 0.5)::bigint as nearest from {SHAPES_SQL}",
    )


def _types() -> None:
    nested = {
        "s": "struct(l_orderkey as k, struct(l_shipdate as d, l_returnflag as f, nullif(l_tax, l_tax) as none) as inner)",
        "list": "array(l_tax)", "pairs": "map(l_returnflag, l_tax)", "flag": "l_quantity > 5", "l_quantity": "l_quantity",
    }
    kind = lambda c: f"case when count({c}) = 0 then 'unknown' when count(try_cast({c}::varchar as timestamp)) >= 0.8 * count({c}) then 'temporal' when count(try_cast({c}::varchar as double)) > 0.9 * count({c}) then 'numeric' else 'categorical' end"
    named = (("s.k", 0, kind("l_orderkey")), ("s.inner.d", 1, kind("l_shipdate")), ("s.inner.f", 2, kind("l_returnflag")), ("s.inner.none", 3, kind("nullif(l_tax, l_tax)")), ("l_quantity", 7, kind("l_quantity")))
    register(
        "infer_types_nested",
        lambda sp, d: ops.infer_types(derived(table(sp, d, "lineitem"), nested)),
        " union all ".join(f"select '{n}' as \"column\", {i}::int as ordinal, {k} as type from lineitem" for n, i, k in named)
        + " union all select * from (values ('list', 4::int, 'unknown'), ('pairs', 5::int, 'unknown'), ('flag', 6::int, 'unknown')) t",
    )
    ev = ("event_id", "ts", "user_id", "event_type", "value", "props")
    evt = "(select " + ", ".join(f"cast({c} as varchar) as {c}" for c in ev) + ", event_id as o from events)"
    loose = lambda c: LOOSE_SQL.format(c)

    def typed(sp, d, policy):
        return ops.infer_types(as_text(table(sp, d, "events")).withColumn("o", F.col("event_id").cast("bigint")), policy, ev, ["o"])

    def rule(kind, source=evt, agg=""):
        return each(ev, lambda c, i: f"select '{c}' as \"column\", {i} as ordinal, {kind(c)} as type from {source(c) if callable(source) else source}")

    first = lambda n: f"(select * from {evt} order by o limit {n})"
    ranked = lambda c: f"(select {c}, row_number() over (order by o) as rn from {first(100)} where {c} <> '')"
    values = lambda n: lambda c: f"(select {c} from {evt} where {c} <> '' order by o limit {n})"
    sql = {
        "default": rule(
            lambda c: f"case when count(*) filter ({c} <> '') = 0 then 'unknown' when count(*) filter ({dated_sql(c)}) >= 0.8 * count(*) filter ({c} <> '') then 'temporal' "
            f"when count({whole_sql(c)}) > 0.9 * count(*) filter ({c} <> '') then 'numeric' else 'categorical' end"
        ),
        "stream": rule(
            lambda c: f"case when count({strict_sql(c)}) > 0.9 * count(*) filter ({c} <> '') then 'numeric' when count({strict_sql(c)}) > 0 and count({strict_sql(c)}) < count(*) filter ({c} <> '') "
            "then 'mixed' else 'categorical' end"
        ),
        "head": rule(
            lambda c: f"case when count(*) = 0 then 'unknown' when bool_and({dated_sql(c, True)}) filter (rn <= 5) then 'temporal' "
            f"when bool_and({loose(c)} is not null) filter (rn <= 10) then 'numeric' else 'categorical' end",
            ranked,
        ),
        "integrity": rule(
            lambda c: f"case when count(*) = 0 then 'unknown' when avg(({dated_sql(c)})::int) >= 0.8 then 'date' when avg(({loose(c)} is not null)::int) >= 0.8 then 'numeric' else 'categorical' end",
            values(50),
        ),
        "metadata": rule(
            lambda c: f"case when count({loose(c)}) > 0.7 * count({c}) then 'numeric' when (select avg(({dated_sql(c)})::int) from {values(100)(c)}) > 0.8 then 'temporal' else 'categorical' end"
        ),
        "plan": rule(
            lambda c: f"case when count(*) filter ({c} <> '') = 0 then null when count(*) filter (({whole_sql(c)}) is null and ({date_sql(c)}) is not null) > 0.8 * count(*) filter ({c} <> '') then 'temporal' "
            f"when count({whole_sql(c)}) > 0.8 * count(*) filter ({c} <> '') then 'numeric' else 'categorical' end",
            first(100),
        ),
        "accuracy": rule(lambda c: f"case when count({loose(c)}) > 0.8 * count(*) then 'numeric' else 'categorical' end", first(20)),
    }
    for policy, text in sql.items():
        register(f"infer_types_{policy}", lambda sp, d, policy=policy: typed(sp, d, policy), text)
    register(
        "count_by_type",
        lambda sp, d: ops.count_by_type(typed(sp, d, "default")),
        f"select type, count(*) as columns from ({sql['default']}) group by type",
    )


def _recommendations() -> None:
    num = ("o_orderkey", "o_custkey", "o_totalprice")
    cat = ("o_orderstatus", "o_orderpriority")
    # what the rules ask about each column of orders
    facts = (
        "with n as (select \"column\", ordinal, count(v) as n, count(distinct v) > 0.2::double * count(v) and count(v) >= 10 as cont, avg(v) as mean, "
        f"{at(0.25)} as q1, {at(0.5)} as mid, {at(0.75)} as q3 from {ordered('orders', num)} group by all), "
        f"o as (select n.\"column\", n.ordinal + 1 as place, any_value(cont) as cont, abs(any_value(mean) - any_value(mid)) > abs(any_value(mean)) * 0.2::double as skewed, "
        f"count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) > 0.05::double * any_value(n.n) as outl from n join {cells_sql('orders', num)} c on c.\"column\" = n.\"column\" group by all), "
        "c as (" + each(cat, lambda c, i: f"select '{c}' as \"column\", {i + 1} as place, count(distinct {c}) as card from orders") + "), "
        "pairs as (select a.\"column\" as x, b.\"column\" as y, a.place as px, b.place as py from o a join o b on a.place < b.place) "
    )
    fields = "type, priority, category, x, y, size, columns, title"
    all_num = ",".join(num)

    def row(source, type_, priority, category, title, x="null", y="null", size="null", columns="null", key="0"):
        return (
            f"select {type_} as type, '{priority}' as priority, {category} as category, {x} as x, {y} as y, {size} as size, {columns} as columns, {title} as title, "
            f"{key} as k from {source}"
        )

    def numbered(rules_, by_priority=False, limit=None):
        parts = " union all ".join(f"select *, {i} as sec from ({q})" for i, q in enumerate(rules_))
        prio = "case priority when 'high' then 0 when 'medium' then 1 else 2 end, " if by_priority else ""
        out = f"select cast(row_number() over (order by {prio}sec, k) as int) as seq, {fields} from ({parts})"
        return out if limit is None else f"select * from ({out}) where seq <= {limit}"

    def show(df):
        return df.withColumn("columns", F.array_join("columns", ","))

    def q(x):
        return f"'{x}'"

    dist, corr_, series, cats = q("distributions"), q("correlations"), q("time_series"), q("categorical_analysis")
    hist_rule = row("o where cont", q("histogram"), "high", dist, "'Distribution of ' || \"column\"", x='"column"', key="place")
    recommend = numbered(
        [
            hist_rule,
            row("o", q("line"), "high", series, "\"column\" || ' over Time'", x=q("o_orderdate"), columns='"column"', key="place"),
            row("(select * from pairs order by px, py limit 5)", q("scatter"), "medium", corr_, "y || ' vs ' || x", x="x", y="y", key="px * 100 + py"),
            row("(select 1)", q("correlationMatrix"), "high", corr_, q("Correlation Matrix"), columns=q(all_num)),
            row("(select c.\"column\" as a, o.\"column\" as b, c.place * 100 + o.place as pl from c, o)", q("bar"), "medium", cats, "b || ' by ' || a", x="a", y="b", key="pl"),
        ]
    )
    profile = lambda sp, d: plans.chart_profile(table(sp, d, "orders"))
    register("recommend_charts", lambda sp, d: show(plans.recommend_charts(profile(sp, d))), facts + recommend)
    hist_two = row("o where cont", q("histogram"), "high", dist, "'Distribution of ' || \"column\"", x='"column"', key="place * 100")
    box = row("o where skewed or outl", q("boxplot"), "high", dist, "'Boxplot of ' || \"column\"", x='"column"', key="place * 100 + 1")
    groups = (
        row("c", "case when card <= 10 then 'bar' else 'horizontalBar' end", "high", cats, "'o_orderkey by ' || \"column\"", x='"column"', y=q("o_orderkey"), key="place * 100")
        + " union all "
        + row("c where card <= 20", "case when card <= 7 then 'pie' else 'treemap' end", "medium", cats, "'Distribution of ' || \"column\"", x='"column"', y=q("count"), key="place * 100 + 1")
    )
    optimal_rules = [
        row("(select count(*) as n from orders having count(*) < 50)", q("table"), "high", q("overview"), q("Data Overview"),
            columns=q("o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority")),
        f"{hist_two} union all {box}",
        row("(select 1)", q("line"), "high", series, q("Time Series Analysis"), x=q("o_orderdate"), columns=q(all_num)),
        row("(select 1)", q("correlationMatrix"), "high", corr_, q("Correlation Matrix"), columns=q(all_num)),
        row("(select * from pairs order by px, py limit 3)", q("scatter"), "medium", corr_, "y || ' vs ' || x", x="x", y="y", key="px * 100 + py"),
        row("(select 1)", q("bubble"), "medium", corr_, q("o_custkey vs o_orderkey (size: o_totalprice)"), x=q(num[0]), y=q(num[1]), size=q(num[2])),
        groups,
        row("(select 1 where (select max(card) from c) <= 20)", q("heatmap"), "medium", cats, q("Relationship between o_orderstatus and o_orderpriority"), x=q(cat[0]), y=q(cat[1])),
        row("(select 1)", q("scatter"), "low", q("anomaly_detection"), q("Outlier Detection"), x=q(num[0]), y=q(num[1])),
    ]
    optimal = numbered(optimal_rules, True, 10)
    register("optimal_charts", lambda sp, d: show(plans.optimal_charts(profile(sp, d))), facts + optimal)
    own = [
        row("o", q("line"), "high", series, "\"column\" || ' over time'", x=q("o_orderdate"), columns='"column"', key="place"),
        row("pairs where px <= 3 and py <= 4", q("scatter"), "medium", corr_, "x || ' vs ' || y", x="x", y="y", key="px * 100 + py"),
        row("o where place <= 5", q("histogram"), "medium", dist, "'Distribution of ' || \"column\"", x='"column"', key="place"),
        row("c", q("bar"), "medium", cats, "\"column\" || ' Distribution'", x='"column"', y=q("count"), key="place * 100")
        + " union all "
        + row("c", q("bar"), "medium", cats, "'o_orderkey by ' || \"column\"", x='"column"', y=q("o_orderkey"), key="place * 100 + 1"),
    ]
    own_all = " union all ".join(f"select * from ({p})" for p in own)
    extra = (
        f"select {fields}, seq as k from ({numbered(optimal_rules, True)}) a where seq <= 16 - (select count(*) from ({own_all})) and not exists (select 1 from ({own_all}) b "
        "where a.type = b.type and a.title = b.title and a.x is not distinct from b.x and a.y is not distinct from b.y)"
    )
    register(
        "progressive_charts",
        lambda sp, d: show(plans.progressive_charts(profile(sp, d), 16)),
        facts + numbered([*own, extra], limit=16),
    )
    register(
        "charts_by_category",
        lambda sp, d: plans.by_category(plans.recommend_charts(profile(sp, d))).withColumn("titles", F.array_join("titles", ",")),
        facts + f"select category, count(*) as charts, string_agg(title, ',' order by seq) as titles from ({recommend}) group by category",
    )
    one = "select 1 as seq, {} as type, 'high' as priority, {} as category, {} as x, {} as y, null as size, {} as columns, {} as title"
    register(
        "select_chart",
        lambda sp, d: show(plans.select_chart(profile(sp, d))),
        one.format(q("line"), series, q("o_orderdate"), "null", q(all_num), q("Time Series of " + ", ".join(num))),
    )
    register(
        "select_chart_for_columns",
        lambda sp, d: show(plans.select_chart_for(profile(sp, d), "o_orderpriority", "o_totalprice")),
        facts + one.format(
            "(select case when card > 10 then 'horizontalBar' else 'bar' end from c where place = 2)", cats, q("o_orderpriority"), q("o_totalprice"), "null", q("o_totalprice by o_orderpriority")
        ),
    )
    register(
        "suggested_charts",
        lambda sp, d: show(plans.suggested_charts(ops.infer_types(table(sp, d, "orders"), "integrity"))),
        numbered(
            [
                row("(select 1)", q("line"), "high", series, q("o_orderkey Over Time"), x=q("o_orderdate"), y=q("o_orderkey")),
                row("(select 1)", q("scatter"), "high", corr_, q("o_custkey vs o_orderkey"), x=q(num[0]), y=q(num[1])),
                row("(select 1)", q("heatmap"), "medium", cats, q("Correlation Matrix"), columns="'o_orderkey,o_custkey,o_totalprice' || (case when (select avg((" + LOOSE_SQL.format("o_orderpriority") + " is not null)::int) from orders) >= 0.8 then ',o_orderpriority' else '' end)"),
                row("(select 1)", q("histogram"), "medium", dist, q("Distribution of o_orderkey"), x=q("o_orderkey")),
                row("(select 1)", q("bar"), "medium", cats, q("o_orderkey by o_orderstatus"), x=q("o_orderstatus"), y=q("o_orderkey")),
            ]
        ),
    )

    # features and insights of documents
    kinds = {"doc_id": "numeric", "text": "categorical", "lang": "categorical", "source": "categorical", "n_chars": "numeric"}
    nums, texts = ("doc_id", "n_chars"), ("text", "lang", "source")
    nq = (
        f"select q.\"column\", 'numeric' as type, 0::bigint as missing, 0.0::double as missing_pct, count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers, "
        f"count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) * 100.0::double / count(*) as outlier_pct, avg(d*d*d) / power(avg(d*d), 1.5) as skewness, "
        f"avg(d*d) as variance, null::bigint as unique_values, null as most_frequent, null::double as most_pct from (select \"column\", {at(0.25)} as q1, {at(0.75)} as q3 from {ordered('documents', nums)} group by \"column\") q "
        f"join {centered('documents', nums)} c on c.\"column\" = q.\"column\" group by q.\"column\""
    )
    tq = each(
        texts,
        lambda c, i: f"select '{c}' as \"column\", 'categorical' as type, (select count(*) from documents) - sum(n)::bigint as missing, "
        f"((select count(*) from documents) - sum(n)) * 100.0::double / (select count(*) from documents) as missing_pct, null::bigint as outliers, null::double as outlier_pct, "
        f"null::double as skewness, null::double as variance, count(*) as unique_values, arg_max(v, rk) as most_frequent, max(n) * 100.0::double / sum(n) as most_pct from "
        f"(select v, n, row_number() over (order by n, v desc) as rk from (select {c} as v, count(*) as n from documents where {c} <> '' group by 1))",
    )
    features_sql = f"with f as ({nq} union all {tq}) "
    register(
        "feature_profile",
        lambda sp, d: rounded(plans.feature_profile(table(sp, d, "documents"), kinds), variance=2).drop("ordinal"),
        features_sql + f"select \"column\", type, missing, {r('missing_pct')} as missing_pct, outliers, {r('outlier_pct')} as outlier_pct, {r('skewness')} as skewness, "
        f"{r('variance', 2)} as variance, unique_values, most_frequent, {r('most_pct')} as most_pct from f",
    )

    def found(sp, d):
        df = table(sp, d, "documents")
        pairs = shape.settle(ops.correlated_pairs(ops.pearson_pairs(df, nums)))
        return plans.insights(df, plans.feature_profile(df, kinds), pairs)

    def ins(section, kind, desc, cond, feature='"column"', severity="null", rec="null", source="f"):
        return f"select '{section}' as section, {feature} as feature, {kind} as kind, {severity} as severity, {desc} as description, {rec} as recommendation from {source} where {cond}"

    insight_sql = " union all ".join(
        [
            "select 'summary' as section, null as feature, 'size' as kind, null as severity, (select count(*) from documents) || ' records with 5 columns' as description, null as recommendation",
            "select 'summary', null, 'types', null, '2 numeric, 3 categorical and 0 temporal columns', null",
            ins("quality_issues", q("missing_values"), "printf('\"%s\": %d missing values (%.2f%%)', \"column\", missing, missing_pct)", "missing > 0",
                severity="case when round(missing_pct, 2) > 20 then 'high' when round(missing_pct, 2) > 5 then 'medium' else 'low' end"),
            ins("quality_issues", q("outliers"), "printf('\"%s\": %d outliers (%.2f%%)', \"column\", outliers, outlier_pct)", "outliers > 0",
                severity="case when round(outlier_pct, 2) > 10 then 'high' when round(outlier_pct, 2) > 2 then 'medium' else 'low' end"),
            ins("distribution_insights", q("skewed_distribution"),
                "printf('\"%s\" is %s (skewness %.2f)', \"column\", case when skewness > 0 then 'right-skewed' else 'left-skewed' end, skewness)", "abs(skewness) > 1",
                rec="case when skewness > 1 then 'Try a log transformation' end"),
            ins("distribution_insights", q("low_variance"), "printf('\"%s\" hardly varies (variance %.6f)', \"column\", variance)", "variance < 0.01",
                rec=q("Unlikely to help a prediction")),
            ins("distribution_insights", q("high_cardinality"), "printf('\"%s\" has %d distinct values', \"column\", unique_values)", "unique_values > 100",
                rec=q("Merge rare categories")),
            ins("distribution_insights", q("imbalanced_categories"), "printf('\"%s\" is mostly \"%s\" (%.2f%%)', \"column\", most_frequent, most_pct)", "round(most_pct, 2) > 80",
                rec=q("Balance the classes before modelling")),
            ins("correlation_insights", "case when abs(c) > 0.9 then 'strong_correlation' else 'moderate_correlation' end",
                "printf('\"doc_id\" and \"n_chars\" correlate %sly (%.2f)', case when c > 0 then 'positive' else 'negative' end, c)", "abs(c) > 0.7", feature=q("doc_id, n_chars"),
                rec="case when abs(c) > 0.9 then 'Drop one of the two' else 'Mind multicollinearity' end", source="(select corr(doc_id, n_chars) as c from documents)"),
        ]
    )
    register("insights", found, features_sql + insight_sql)
    register(
        "insight_recommendations",
        lambda sp, d: plans.insight_recommendations(found(sp, d)).drop("description"),
        features_sql + f", i as ({insight_sql}) select * from (values ('data_cleaning', 'high'), ('feature_selection', 'medium'), ('transformation', 'medium'), ('feature_engineering', 'medium')) a(type, priority) where "
        "(type = 'data_cleaning' and exists (select 1 from i where severity = 'high')) or (type = 'feature_selection' and exists (select 1 from i where kind = 'strong_correlation')) or "
        "(type = 'transformation' and exists (select 1 from i where kind = 'skewed_distribution')) or (type = 'feature_engineering' and exists (select 1 from i where kind = 'high_cardinality'))",
    )


for _group in (_summaries, _order, _frequencies, _time, _correlations, _charts, _quality, _reconcile, _parsing, _types, _recommendations):
    _group()


try:  # training-data operators, an optional part
    import corpus_pipeline
    from plumbline.llm import queries as _llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "plumbline.llm"):
        raise
else:
    _QUERIES.update(_llm.QUERIES)
    _QUERIES["pipeline"] = corpus_pipeline.run
    _ORACLES.update(_llm.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Column summary with mean, type and counts of every lineitem column."""
    return ops.column_summary(table(spark, SMOKE_DIR, "lineitem"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
