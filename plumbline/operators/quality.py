"""Scored data-quality report.

Every rule says what it makes of a row: whether it hits and counts, the cell's class, its
year or its spelling.  All rules of a report are read in
one scan, unpivoted to a row per rule and counted by rule and outcome with map-side
combination (``measure``), so neither rules nor columns add scans.  Exact quartiles and
duplicate rows come from operators of their own.  Thresholds, ranges, name parts and
deductions are a ``Rules`` value.  The result is an issue table: one row per finding, with
what it takes off the score.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_text, in_domain, integer_prefix, is_icd10, is_postcode, loose_number
from plumbline.operators import rules
from plumbline.operators.columns import Cell, cells, local_table, long, settle
from plumbline.operators.duplicates import duplicate_count
from plumbline.operators.infer import first_rows, type_map
from plumbline.operators.quantiles import outside, quartile_table
from plumbline.operators.rules import DEFAULT, Rules
from plumbline.shared import cut, spread

ISSUE_SCHEMA = (
    "category string, kind string, column string, type string, severity string, "
    "affected bigint, pct double, deduction int, description string"
)
# Gaps between years that a description lists.
LISTED_VALUES = 10
# Years in one slot when gaps between years are looked for.
YEAR_SLOT = 1000


@dataclass
class Check:
    """One rule on one column: the rows it hits, and how their share maps to a finding.

    ``whole`` says which rows the share is taken of, all by default.  With ``classes``, a
    number from 1 to 3 or 0 for rows that do not count, the rule counts the rows outside the
    largest class instead.
    """

    category: str
    type: str
    column: str | None
    hit: Column | None
    ladder: Sequence[tuple[float, str, int]]
    text: str
    whole: Column | None = None
    kind: str = "issue"
    type_by_severity: dict[str, str] = field(default_factory=dict)
    classes: Column | None = None


@dataclass
class Newest:
    """The newest year of a column."""

    column: str
    year: Column


@dataclass
class Values:
    """The distinct values of a column, years or text."""

    column: str
    value: Column
    of_years: bool = False


def number_of(c: Cell) -> Column:
    return loose_number(c.raw) if c.is_text else c.number()


def _ladder(value: Column, ladder, pick: int, dtype: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast(dtype))
    for step in ladder:
        out = out.when(value > F.lit(step[0]), F.lit(step[pick]).cast(dtype))
    return out


CHECK_SCHEMA = (
    "seq int, classed boolean, category string, kind string, column string, type string, major_type string, text string, "
    + ", ".join(f"limit{i} double, severity{i} string, deduction{i} int" for i in range(3))
)


# A check's code holds whether the row is hit and whether it counts, or from CLASSES on the cell's class.
HIT, COUNTS, CLASSES = 1, 2, 4


def measure(df: DataFrame, parts: Sequence[Check | Newest | Values]) -> DataFrame:
    """``(seq, code, item, n)``: how often every rule met each outcome, after one scan.

    The outcome is a check's code, a year, or an item: as many rows as rules have outcomes.
    """

    def code(p: Check | Newest | Values) -> Column:
        if isinstance(p, Newest):
            return p.year
        if isinstance(p, Values):
            return p.value if p.of_years else F.lit(None)
        if p.classes is not None:
            return CLASSES + p.classes
        return F.when(p.hit, HIT).otherwise(0) + (F.lit(COUNTS) if p.whole is None else F.when(p.whole, COUNTS).otherwise(0))

    def item(p: Check | Newest | Values) -> Column:
        return p.value if isinstance(p, Values) and not p.of_years else F.lit(None)

    outcomes = [F.struct(code(p).cast("long").alias("code"), item(p).cast("string").alias("item")) for p in parts]
    unpivoted = df.select(F.posexplode(F.array(*outcomes)).alias("seq", "x")).select("seq", "x.code", "x.item")
    return unpivoted.groupBy("seq", "code", "item").agg(F.count(F.lit(1)).alias("n"))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Findings of the given checks, out of one scan."""
    return findings(measure(df, checks), checks) if checks else local_table(df.sparkSession, [], ISSUE_SCHEMA)


def findings(state: DataFrame, parts: Sequence[Check | Newest | Values]) -> DataFrame:
    """Findings of the checks among ``parts``: their state against the table of their ladders and texts."""
    rows = [_check_row(j, c) for j, c in enumerate(parts) if isinstance(c, Check)]
    if not rows:
        return local_table(state.sparkSession, [], ISSUE_SCHEMA)
    table = local_table(state.sparkSession, rows, CHECK_SCHEMA)
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    bit = lambda x: F.col("code").bitwiseAND(F.lit(x)) != 0
    classes = [some(F.col("code") == CLASSES + i) for i in (1, 2, 3)]
    classed = F.col("code") >= CLASSES
    counted = state.groupBy("seq").agg(
        some(~classed & bit(HIT)).alias("hits"), some(F.when(classed, F.col("code") > CLASSES).otherwise(bit(COUNTS))).alias("whole"), F.greatest(*classes).alias("largest")
    )
    affected = F.when(F.col("classed"), F.col("whole") - F.col("largest")).otherwise(F.col("hits"))
    counted = counted.join(F.broadcast(table), "seq").withColumn("affected", affected)
    pct = F.try_divide(F.col("affected") * 100.0, F.col("whole").cast("double"))
    found = counted.where(F.col("affected") > 0).withColumn("pct", pct)  # one row per check
    reached = [F.col("pct") > F.col(f"limit{i}") for i in range(3)]

    def step_of(name: str) -> Column:
        return F.when(reached[0], F.col(f"{name}0")).when(reached[1], F.col(f"{name}1")).when(reached[2], F.col(f"{name}2"))

    major = F.col("severity") == "major"
    return (
        found.withColumn("severity", step_of("severity"))
        .withColumn("deduction", step_of("deduction"))
        .where(F.col("severity").isNotNull())
        .select(
            "category",
            "kind",
            "column",
            F.when(major, F.coalesce("major_type", "type")).otherwise(F.col("type")).alias("type"),
            "severity",
            F.col("affected").cast("bigint").alias("affected"),
            "pct",
            "deduction",
            _filled(F.col("text"), F.col("affected"), F.col("pct"), F.col("column")).alias("description"),
        )
    )


def _filled(text: Column, affected: Column, pct: Column, column: Column) -> Column:
    """The text with its numbers, and last the column's name, put in."""
    counted = F.replace(text, F.lit("{affected}"), affected.cast("string"))
    shared = F.replace(counted, F.lit("{share}"), fixed_text(pct))
    return F.replace(shared, F.lit("{column}"), F.coalesce(column, F.lit("")))


def _check_row(seq: int, c: Check) -> tuple:
    steps = [x for s in c.ladder for x in (float(s[0]), s[1], s[2])]
    return (seq, c.classes is not None, c.category, c.kind, c.column, c.type, c.type_by_severity.get("major"), c.text, *steps, *[None] * (9 - len(steps)))


# -- completeness ------------------------------------------------------------------


def completeness_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    every = cells(df)
    out = [
        Check(
            "Completeness", "missing_values", c.name, c.missing, rule.missing,
            f'Column "{{column}}": {{affected}} cells missing ({{share}}%)',
        )
        for c in every
    ]
    empty = reduce(lambda a, b: a + b, [c.missing.cast("int") for c in every])
    out.append(
        Check(
            "Completeness", "incomplete_rows", None, empty > len(every) * rule.incomplete_share, rule.incomplete,
            f"{{affected}} rows ({{share}}%) miss more than {_part(rule.incomplete_share)} of their cells",
        )
    )
    return out


def _part(share: float) -> str:
    return "half" if share == 0.5 else f"{share:g}"


def missing_by_column(df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    return run_checks(df, completeness_checks(df, rule)[:-1])


def incomplete_rows(df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    return run_checks(df, completeness_checks(df, rule)[-1:])


# -- consistency -------------------------------------------------------------------


def mixed_type_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    """Cells outside the column's most common class (number, date, text)."""
    out = []
    for c in cells(df):
        if not c.is_text:
            continue
        class_ = F.when(c.missing, 0).when(c.number("whole").isNotNull(), 1).when(c.looks_dated(), 2).otherwise(3)
        out.append(
            Check(
                "Consistency", "mixed_types", c.name, None, rule.any_major,
                'Column "{column}" mixes data types: {affected} cells ({share}%) are not of its main type', classes=class_,
            )
        )
    return out


def share_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    named = rules.columns_with(df.columns, rule.share_words)
    return [
        Check(
            "Consistency", "logical_inconsistency", c.name, number_of(c) > rule.share_limit,
            rule.any_major, f'Column "{{column}}": {{affected}} values ({{share}}%) exceed {rule.share_limit:g}',
        )
        for c in cells(df, named)
    ]


def mixed_types(df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    return run_checks(df, mixed_type_checks(df, rule))


def _grown(row: DataFrame, category: str, kind: str, column: str | None, type_: str, ladder, text: Column) -> DataFrame:
    """Finding from a one-row table with ``affected`` and ``pct``."""
    return row.select(
        F.lit(category).alias("category"),
        F.lit(kind).alias("kind"),
        F.lit(column).cast("string").alias("column"),
        F.lit(type_).alias("type"),
        F.when(F.col("affected") > 0, _ladder(F.col("pct"), ladder, 1, "string")).alias("severity"),
        F.col("affected").cast("bigint").alias("affected"),
        F.col("pct").cast("double").alias("pct"),
        _ladder(F.col("pct"), ladder, 2, "int").alias("deduction"),
        text.alias("description"),
    ).where(F.col("severity").isNotNull())


def duplicate_issue(df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    counted = duplicate_count(df).select(F.col("duplicates").alias("affected"), "pct")
    text = F.format_string("%d rows (%s%%) repeat an earlier row", F.col("affected").cast("bigint"), fixed_text(F.col("pct")))
    return _grown(counted, "Consistency", "issue", None, "duplicate_rows", rule.duplicates, text)


def year_values(df: DataFrame, rule: Rules = DEFAULT) -> list[Values]:
    """The distinct years of the column that the rules name."""
    if rule.year_column not in df.columns:
        return []
    c = cells(df, [rule.year_column])[0]
    return [Values(c.name, (c.year() if c.is_time else integer_prefix(c.text())).cast("long"), of_years=True)]


def year_gap_issue(state: DataFrame, parts: Sequence[Check | Newest | Values], rule: Rules = DEFAULT) -> DataFrame:
    """Warning when the years of a column leave years out.

    A year's neighbour is looked for among the years of its slot, and that of the first year
    of a slot among the slots' last years; so no task sees more than a slot, or a row for each.
    """
    wanted = [j for j, p in enumerate(parts) if isinstance(p, Values) and p.of_years]
    if not wanted:
        return local_table(state.sparkSession, [], ISSUE_SCHEMA)
    years = state.where((F.col("seq") == wanted[0]) & F.col("code").isNotNull()).select(F.col("code").alias("year"))
    years = years.withColumn("slot", F.floor(F.col("year") / YEAR_SLOT))
    last = years.groupBy("slot").agg(F.max("year").alias("last")).select("slot", F.lag("last").over(Window.orderBy("slot")).alias("carried"))
    near = F.lag("year").over(Window.partitionBy("slot").orderBy("year"))
    gaps = years.withColumn("near", near).join(last, "slot").withColumn("before", F.coalesce("near", "carried")).where(F.col("year") > F.col("before") + 1)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    first = gaps.select("before", "year", total.alias("affected")).orderBy("year").limit(LISTED_VALUES)
    found = first.agg(
        F.coalesce(F.max("affected"), F.lit(0)).alias("affected"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("year", "before"))), lambda x: F.format_string("%d-%d", x["before"], x["year"])), ", ").alias("spans"),
    )
    more = F.when(F.col("affected") > LISTED_VALUES, F.format_string(" and %d more", F.col("affected") - LISTED_VALUES)).otherwise("")
    text = F.concat(F.format_string("%d gaps between years: %s", "affected", "spans"), more)
    ladder = ((0.0, "minor", rule.year_deduction),)
    return _grown(found.withColumn("pct", F.col("affected") * 1.0), "Consistency", "warning", rule.year_column,
                  "chronological_gaps", ladder, text).withColumn("pct", F.lit(None).cast("double"))


# -- accuracy ----------------------------------------------------------------------


def outlier_checks(df: DataFrame, columns: Sequence[str], rule: Rules = DEFAULT) -> list[Check]:
    picked = cells(df, columns)
    if not picked:
        return []
    table = quartile_table(df, picked, rule.fence)
    out = []
    for c in picked:
        q, v = table[c.name], c.number()
        out.append(
            Check(
                "Accuracy", "outliers", c.name, outside(v, q["lower_bound"], q["upper_bound"]),
                rule.outliers, f'Column "{{column}}": {{affected}} values ({{share}}%) beyond the interquartile fences',
                whole=v.isNotNull(), type_by_severity={"major": "extreme_outliers"},
            )
        )
    return out


def person_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    out = []
    for m in rule.person_ranges:
        name = rules.first_named(df.columns, m.words[0], m.words[0])
        if name is None:
            continue
        v = number_of(cells(df, [name])[0])
        out.append(
            Check(
                "Accuracy", "unrealistic_values", name, (v < m.low) | (v > m.high), rule.any_major,
                f'Column "{{column}}": {{affected}} values ({{share}}%) outside {m.low:g} to {m.high:g}',
            )
        )
    return out


# -- validity ----------------------------------------------------------------------


def validity_checks(df: DataFrame, match: str = "substring", rule: Rules = DEFAULT) -> list[Check]:
    out = []
    name = rules.first_named(df.columns, "Postcode", "postcode", fold=True)
    if name is not None:
        c = cells(df, [name])[0]
        out.append(
            Check(
                "Validity", "invalid_format", name, ~c.missing & ~is_postcode(c.text()), rule.any_minor,
                f'Column "{{column}}": {{affected}} values ({{share}}%) are not four-digit postcodes',
            )
        )
    for m in rule.measurements:
        for c in cells(df, rules.columns_with(df.columns, m.words, match)):
            v = number_of(c)
            out.append(
                Check(
                    "Validity", "invalid_health_measurement", c.name, (v < m.low) | (v > m.high),
                    rule.health,
                    f'Column "{{column}}": {{affected}} values ({{share}}%) outside {m.low:g} to {m.high:g} for {m.name}',
                )
            )
    return out


def range_checks(df: DataFrame, ranges: Sequence[tuple[str, float, float]], rule: Rules = DEFAULT) -> DataFrame:
    """Findings for a caller's own rule table of ``(column, low, high)``."""
    out = []
    for name, low, high in ranges:
        v = number_of(cells(df, [name])[0])
        out.append(
            Check(
                "Accuracy", "unrealistic_values", name, (v < float(low)) | (v > float(high)),
                rule.any_major, f'Column "{{column}}": {{affected}} values ({{share}}%) outside {low:g} to {high:g}',
            )
        )
    return run_checks(df, out)


# -- timeliness --------------------------------------------------------------------


def newest_years(df: DataFrame, columns: Sequence[str] | None = None) -> list[Newest]:
    names = list(columns) if columns is not None else rules.dated_columns(df.columns)
    return [Newest(c.name, _year(c)) for c in cells(df, names)] if names else []


def timeliness(df: DataFrame, as_of_year: int, columns: Sequence[str] | None = None, rule: Rules = DEFAULT) -> DataFrame:
    """Age of the newest value of each date or year column, in years."""
    parts = newest_years(df, columns)
    return ages(measure(df, parts) if parts else None, parts, as_of_year, df, rule)


def ages(state: DataFrame | None, parts: Sequence[Check | Newest | Values], as_of_year: int, df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    """Findings of the ``Newest`` rules among ``parts``; one of its own where there is none."""
    picked = [(j, p.column) for j, p in enumerate(parts) if isinstance(p, Newest)]
    if not picked:
        row = ("Timeliness", "warning", None, "no_temporal_columns", "minor", None, None, 0,
               "No column is named like a date or a year")
        return local_table(df.sparkSession, [row], ISSUE_SCHEMA)
    age = F.col("age")
    kind = F.when(F.lit(False), "")
    severity, deduction = kind, F.when(F.lit(False), 0)
    for limit, k, s, d in rule.ages:
        kind, severity, deduction = (
            kind.when(age > limit, k), severity.when(age > limit, s), deduction.when(age > limit, d)
        )
    names = local_table(df.sparkSession, picked, "seq int, column string")
    return (
        state.join(F.broadcast(names), "seq")  # one row per column
        .groupBy("column")
        .agg((F.lit(as_of_year) - F.max("code")).alias("age"))
        .select(
            F.lit("Timeliness").alias("category"),
            kind.alias("kind"),
            "column",
            F.lit("outdated_data").alias("type"),
            severity.alias("severity"),
            F.lit(None).cast("bigint").alias("affected"),
            F.lit(None).cast("double").alias("pct"),
            deduction.alias("deduction"),
            F.format_string("The newest value is %d years old (%d)", age, F.lit(as_of_year) - age).alias("description"),
        )
        .where(F.col("severity").isNotNull())
    )


def _year(c: Cell) -> Column:
    if c.is_time:
        return c.year()
    return integer_prefix(c.text()) if "year" in c.name.lower() else c.year()


# -- local context -----------------------------------------------------------------


def domain_values(df: DataFrame, columns: Sequence[str], domain: Sequence[str]) -> DataFrame:
    """``(column, value, inside)``: distinct non-missing spellings and whether the domain has them."""
    rows = long(df, cells(df, columns), lambda c: F.when(~c.missing, c.text()))
    distinct = rows.where(F.col("value").isNotNull()).distinct()
    return distinct.withColumn("inside", in_domain(F.col("value"), domain))


def domain_violations(df: DataFrame, column: str, domain: DataFrame, key: str = "value") -> DataFrame:
    """Distinct values of ``column`` that a domain table does not hold, ignoring case."""
    c = cells(df, [column])[0]
    have = df.where(~c.missing).select(c.text().alias("value")).distinct()
    known = domain.select(F.lower(key).alias("_k")).distinct()
    return have.join(known, F.lower("value") == F.col("_k"), "left_anti")


def domain_matches(df: DataFrame, column: str, domain: DataFrame, key: str = "value") -> DataFrame:
    """Distinct values of ``column`` that a domain table holds, ignoring case."""
    c = cells(df, [column])[0]
    have = df.where(~c.missing).select(c.text().alias("value")).distinct()
    known = domain.select(F.lower(key).alias("_k")).distinct()
    return have.join(known, F.lower("value") == F.col("_k"), "left_semi")


def domain_coverage(
    df: DataFrame, columns: Sequence[str], domain: Sequence[str] = rules.STATES, expected: int = rules.STATE_COUNT
) -> DataFrame:
    """``(column, inside, outside, incomplete)``: distinct spellings in and out of the domain."""
    v = domain_values(df, columns, domain)
    return v.groupBy("column").agg(
        F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside")
    ).withColumn("incomplete", (F.col("inside") > 0) & (F.col("inside") < expected))


def state_values(df: DataFrame, rule: Rules = DEFAULT) -> list[Values]:
    return [Values(c.name, F.when(~c.missing, c.text())) for c in cells(df, rules.columns_with(df.columns, rule.state_words))]


def state_issues(state: DataFrame, parts: Sequence[Check | Newest | Values], rule: Rules = DEFAULT) -> DataFrame:
    """Findings on the distinct spellings of the state columns among ``parts``."""
    words = [(j, p.column) for j, p in enumerate(parts) if isinstance(p, Values) and not p.of_years]
    if not words:
        return local_table(state.sparkSession, [], ISSUE_SCHEMA)
    names = local_table(state.sparkSession, words, "seq int, column string")
    v = state.join(F.broadcast(names), "seq").where(F.col("item").isNotNull())  # one row per column in the names
    v = v.select("column", F.col("item").alias("value"), in_domain(F.col("item"), rule.states).alias("inside"))
    found = v.groupBy("column").agg(
        F.count_if("inside").alias("inside"),
        F.count_if(~F.col("inside")).alias("outside"),
        F.min(F.when(~F.col("inside"), F.col("value"))).alias("example"),
    )
    outside_row = F.struct(
        F.lit("non_australian_states").alias("type"),
        F.col("outside").alias("affected"),
        F.when(F.col("outside") > 0, rule.state_deductions[0]).alias("deduction"),
        F.format_string('Column "%s": %d values are no state or territory, such as %s', "column", "outside",
                        "example").alias("description"),
    )
    cover_row = F.struct(
        F.lit("incomplete_state_coverage").alias("type"),
        F.col("inside").alias("affected"),
        F.when((F.col("inside") > 0) & (F.col("inside") < rule.state_count), rule.state_deductions[1]).alias("deduction"),
        F.format_string('Column "%s": %d of %d states and territories present', "column", "inside",
                        F.lit(rule.state_count)).alias("description"),
    )
    return (
        found.select("column", F.inline(F.array(outside_row, cover_row)))
        .where(F.col("deduction").isNotNull())
        .select(
            F.lit("Australian Context").alias("category"),
            F.lit("warning").alias("kind"),
            "column",
            "type",
            F.lit("minor").alias("severity"),
            "affected",
            F.lit(None).cast("double").alias("pct"),
            "deduction",
            "description",
        )
    )


def unit_name_issues(df: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    """Columns named after a unit not used locally (names only, no data read)."""
    rows = []
    for word, unit, other in rule.units:
        for name in rules.columns_with(df.columns, (word,)):
            if other.lower() in name.lower():
                rows.append(("Australian Context", "warning", name, "non_australian_unit", "minor", None, None, rule.unit_deduction,
                             f'Column "{name}" is named after {other}; the local unit is {unit}'))
    return local_table(df.sparkSession, rows, ISSUE_SCHEMA)


def unit_value_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    out = []
    for word in rule.unit_value_words:
        for c in cells(df, rules.columns_with(df.columns, (word,))):
            out.append(
                Check(
                    "Australian Context", "suspicious_unit", c.name, number_of(c) > rule.unit_value_limit,
                    rule.unit_values, f'Column "{{column}}": {{affected}} values ({{share}}%) look like mg/dL',
                )
            )
    return out


def diagnosis_checks(df: DataFrame, rule: Rules = DEFAULT) -> list[Check]:
    out = []
    for c in cells(df, rules.columns_with(df.columns, rule.diagnosis_words)):
        if c.is_text:
            out.append(
                Check(
                    "Australian Context", "non_standard_classification", c.name,
                    ~c.missing & ~is_icd10(c.raw), rule.diagnoses,
                    f'Column "{{column}}": {{affected}} values ({{share}}%) are no ICD-10 codes',
                    whole=~c.missing, kind="warning",
                )
            )
    return out


# -- report ------------------------------------------------------------------------


def issues(
    df: DataFrame,
    as_of_year: int,
    order_by: Sequence[str] | None = None,
    match: str = "substring",
    numeric: Sequence[str] | None = None,
    rule: Rules = DEFAULT,
) -> DataFrame:
    """All findings of all checks.

    ``order_by`` says which rows the first-rows rules look at; without it they look at all.
    ``numeric`` names the columns checked for outliers, found by the ``accuracy`` policy if absent.
    """
    df = spread(df)
    if numeric is None:
        numeric = [n for n, t in type_map(df, "accuracy", order_by).items() if t == "numeric"]
    early = diagnosis_checks(df, rule)
    parts: list[Check | Newest | Values] = [
        *completeness_checks(df, rule),
        *mixed_type_checks(df, rule),
        *share_checks(df, rule),
        *outlier_checks(df, numeric, rule),
        *person_checks(df, rule),
        *validity_checks(df, match, rule),
        *unit_value_checks(df, rule),
        *([] if order_by else early),
        *newest_years(df),
        *year_values(df, rule),
        *state_values(df, rule),
    ]
    # a row per rule and outcome; several parts of the report read it
    state = cut(measure(df, parts))
    found = [
        findings(state, parts),
        duplicate_issue(df, rule),
        year_gap_issue(state, parts, rule),
        ages(state, parts, as_of_year, df, rule),
        state_issues(state, parts, rule),
        unit_name_issues(df, rule),
    ]
    if order_by:
        found.append(run_checks(first_rows(df, rule.first_rows, order_by), early))
    return reduce(DataFrame.unionByName, found)


def recommendations(found: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    """Advice called for by the findings: ``(category, type, priority, description)``."""
    rows = [(*r, rule.advice_text[r[3]]) for r in rule.advice]
    table = local_table(
        found.sparkSession, rows,
        "category string, trigger string, kind string, advice string, priority string, description string",
    )
    present = found.select("category", "kind", "type").distinct()
    hit = (
        (present["category"] == table["category"])
        & (present["kind"] == table["kind"])
        & (table["trigger"].isNull() | (table["trigger"] == present["type"]))
    )
    return (
        table.join(present, hit, "left_semi")
        .select("category", F.col("advice").alias("type"), "priority", "description")
        .distinct()
    )


def score_summary(df: DataFrame, found: DataFrame, rule: Rules = DEFAULT) -> DataFrame:
    """One row: sizes, findings by severity, score and rating.  An empty table scores 0."""
    is_issue = F.col("kind") == "issue"
    total = found.agg(
        *[
            F.count_if(is_issue & (F.col("severity") == s)).alias(f"{s}_issues")
            for s in ("critical", "major", "minor")
        ],
        F.count_if(~is_issue).alias("warnings"),
        F.coalesce(F.sum("deduction"), F.lit(0)).alias("deductions"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = total.withColumn("total_records", rows).withColumn(
        "score",
        F.when(F.col("total_records") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), 100 - F.col("deductions"))),
    )
    label = F.when(F.col("total_records") == 0, "error")
    for limit, name in rule.ratings:
        label = label.when(F.col("score") < limit, name)
    return scored.select(
        "total_records",
        F.lit(len(df.columns)).alias("total_columns"),
        "critical_issues",
        "major_issues",
        "minor_issues",
        "warnings",
        "score",
        label.otherwise(rule.best_rating).alias("rating"),
    )


def format_recommendations(types: DataFrame, found: DataFrame) -> DataFrame:
    """``(type, priority, columns)``: structure always; dates, missing cells, numbers when present."""
    spark = types.sparkSession
    always = local_table(spark, [("data_structure", "high")], "type string, priority string").withColumn(
        "columns", F.lit(None).cast("array<string>")
    )

    def named(rows: DataFrame, type_: str, priority: str) -> DataFrame:
        listed = F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]
        )
        return (
            rows.groupBy(F.lit(type_).alias("type"), F.lit(priority).alias("priority"))
            .agg(listed.alias("columns"))
            .where(F.size("columns") > 0)
        )

    missing = types.join(
        found.where((F.col("type") == "missing_values") & (F.col("kind") == "issue")).select("column"),
        "column",
        "left_semi",
    )
    return (
        always.unionByName(named(types.where(F.col("type").isin("date", "temporal")), "date_format", "medium"))
        .unionByName(named(missing, "missing_values", "high"))
        .unionByName(named(types.where(F.col("type") == "numeric"), "numeric_format", "medium"))
    )


def quality_report(
    df: DataFrame,
    as_of_year: int,
    order_by: Sequence[str] | None = None,
    match: str = "substring",
    rule: Rules = DEFAULT,
) -> dict[str, DataFrame]:
    """``issues``, ``recommendations``, ``format_recommendations``, ``suggested_charts`` and ``summary`` under the given rules."""
    from plumbline.operators.infer import infer_types
    from plumbline.plans.recommend import suggested_charts

    found = settle(issues(df, as_of_year, order_by, match, rule=rule))  # a few rows per column
    types = settle(infer_types(df, "integrity", order_by=order_by))
    return {
        "issues": found,
        "recommendations": recommendations(found, rule),
        "format_recommendations": format_recommendations(types, found),
        "suggested_charts": suggested_charts(types),
        "summary": score_summary(df, found, rule),
    }
