"""Cell-level expressions: missing tests, number and date parsing, patterns, labels.

Every function takes and returns a ``Column`` built from JVM-side functions, so
they stay inside whole-stage codegen and combine freely with aggregates.  All
parsing is of the ``try_`` kind: under ANSI mode a bad cell yields NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text shapes that decide how a cell is read.
STRICT_NUMBER = r"^(0|-?(0\.\d*[1-9]|[1-9]\d*(\.\d*[1-9])?))$"
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
WHOLE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PREFIX = r"^\s*([+-]?\d+)"
POSTCODE = r"^\d{4}$"
ICD10 = r"^[A-Z]\d\d(\.\d)?$"

# Accepted date shapes and the format that reads each of them.
ISO_DATE = r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?)?$"
OTHER_DATES = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
)

ISO_OUTPUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def is_missing(c: Column, dtype: str = "string") -> Column:
    """NULL, or the empty string for text columns."""
    return c.isNull() | (c == "") if dtype == "string" else c.isNull()


def strict_number(c: Column) -> Column:
    """Text that reads back unchanged after being formatted as a number: ``599.70`` is not one."""
    t = F.trim(c)
    return F.when(t.rlike(STRICT_NUMBER), t.try_cast("double"))


def loose_number(c: Column) -> Column:
    """The longest numeric prefix of the text: ``12abc`` is 12."""
    return F.nullif(F.regexp_extract(c, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")


def whole_number(c: Column) -> Column:
    """Text that is a number from end to end, blanks around it allowed."""
    t = F.trim(c)
    return F.when(t.rlike(WHOLE_NUMBER), t.try_cast("double"))


def integer_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, INTEGER_PREFIX, 1), F.lit("")).try_cast("int")


def parse_date(c: Column) -> Column:
    """Timestamp of the text in one of the accepted shapes, else NULL."""
    t = F.trim(c)
    padded = F.when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t)
    parsed = F.when(t.rlike(ISO_DATE), padded.try_cast("timestamp"))
    for shape, fmt in OTHER_DATES:
        parsed = parsed.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
    return parsed


def is_date(c: Column, month_words: bool = False) -> Column:
    """Parses as a date and shows a separator (or, on request, a jan/feb month word)."""
    marks = c.contains("-") | c.contains("/") | c.contains(":")
    if month_words:
        low = F.lower(c)
        marks = marks | low.contains("jan") | low.contains("feb")
    return F.coalesce(marks & parse_date(c).isNotNull(), F.lit(False))


def epoch_ms(c: Column, dtype: str = "timestamp") -> Column:
    """Milliseconds since 1970 (zone-free timestamps are read as UTC)."""
    if dtype == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
        return F.floor(micros / F.lit(1000.0)).cast("bigint")
    return F.unix_millis(c.cast("timestamp"))


def iso_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), ISO_OUTPUT)


def year_of(c: Column, dtype: str = "string") -> Column:
    return F.year(parse_date(c)) if dtype == "string" else F.year(c)


def weekday(c: Column) -> Column:
    """1 = Sunday."""
    return F.dayofweek(c)


def month_of(c: Column) -> Column:
    return F.month(c)


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    p = F.try_divide(part * F.lit(100.0), whole.cast("double"))
    return p if digits is None else F.round(p, digits)


def fixed_text(c: Column, digits: int = 2) -> Column:
    """Fixed-point text, rounded by the exact value of the double: 36.05, stored a little
    below, gives ``36.0`` at one digit.  True ties go away from zero.

    The scaled value is kept as a product and its rounding error, which together are exact.
    """
    scale = F.lit(10.0**digits)
    x = F.abs(c)
    high = x * F.lit(134217729.0)
    high = high - (high - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    part = product - F.floor(product)
    up = (part > 0.5) | ((part == 0.5) & (error >= 0))
    near = (F.floor(product) + F.when(up, 1).otherwise(0)) / scale
    small = x < F.lit(4503599627370496.0) / scale
    return F.format_string(f"%.{digits}f", F.when(small, F.signum(c) * near).otherwise(c))


def percent_text(p: Column, digits: int = 2) -> Column:
    return fixed_text(p, digits)


def round_half_up(c: Column) -> Column:
    """Round half towards +infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def clamp_non_negative(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def bin_label(lo: Column, hi: Column) -> Column:
    return F.concat(fixed_text(lo, 2), F.lit(" - "), fixed_text(hi, 2))


def is_postcode(c: Column) -> Column:
    return c.rlike(POSTCODE)


def is_icd10(c: Column) -> Column:
    return c.rlike(ICD10)


def in_domain(c: Column, values: Iterable[str]) -> Column:
    """Case-insensitive membership in a short list."""
    return F.lower(c).isin([v.lower() for v in values])


def frequency_key(c: Column) -> Column:
    return c.cast("string")
