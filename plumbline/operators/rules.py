"""Rule tables of the quality report (fixed values)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Fixed values: (share in per cent above which it applies, severity, score deduction).
MISSING_LADDER = ((50.0, "critical", 10), (20.0, "major", 5), (5.0, "minor", 2))
INCOMPLETE_LADDER = ((20.0, "critical", 10), (5.0, "major", 5), (0.0, "minor", 2))
DUPLICATE_LADDER = ((10.0, "critical", 10), (2.0, "major", 5), (0.0, "minor", 2))
OUTLIER_LADDER = ((10.0, "major", 5), (2.0, "minor", 2))
HEALTH_LADDER = ((10.0, "major", 5), (0.0, "minor", 2))
ANY_MAJOR = ((0.0, "major", 5),)
ANY_MINOR = ((0.0, "minor", 2),)

# Fixed values: (age in years above which it applies, kind, severity, deduction).
AGE_LADDER = ((10, "issue", "critical", 10), (5, "issue", "major", 5), (2, "warning", "minor", 2))

# Score below which the rating applies.
RATINGS = ((30, "critical"), (60, "poor"), (80, "fair"), (95, "good"))
BEST_RATING = "excellent"


@dataclass(frozen=True)
class Measurement:
    """Valid range of a measurement and the column name parts it is known by."""

    name: str
    low: float
    high: float
    words: tuple[str, ...]


# Clinical ranges.
MEASUREMENTS = (
    Measurement("Cholesterol", 2.0, 12.0, ("cholesterol", "chol", "total_cholesterol")),
    Measurement("Blood_Pressure_Systolic", 70.0, 250.0, ("sbp", "systolic", "systolic_bp")),
    Measurement("Blood_Pressure_Diastolic", 40.0, 150.0, ("dbp", "diastolic", "diastolic_bp")),
    Measurement("Heart_Rate", 30.0, 220.0, ("hr", "heart_rate", "pulse")),
    Measurement("Blood_Glucose", 2.0, 30.0, ("glucose", "blood_glucose", "bgl")),
    Measurement("HbA1c", 3.5, 20.0, ("hba1c", "a1c", "glycated", "glycated_haemoglobin")),
    Measurement("Weight_kg", 15.0, 300.0, ("weight", "mass_kg", "weight_kg")),
)

# Ranges whose column is found by a case-sensitive word.
PERSON_RANGES = (Measurement("BMI", 12.0, 60.0, ("BMI",)), Measurement("Age", 0.0, 120.0, ("Age",)))

# Shares that cannot exceed 100, by name part.
SHARE_WORDS = ("percent", "rate", "ratio")
SHARE_LIMIT = 100.0

# States and territories, short and long names.
STATES = (
    "NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT",
    "New South Wales", "Victoria", "Queensland", "South Australia",
    "Western Australia", "Tasmania", "Northern Territory", "Australian Capital Territory",
)
STATE_COUNT = 8
STATE_WORDS = ("state", "territory")

# Fixed values: (name part, local unit, other unit).
UNITS = (
    ("cholesterol", "mmol/L", "mg/dL"),
    ("glucose", "mmol/L", "mg/dL"),
    ("hba1c", "%", "mmol/mol"),
    ("weight", "kg", "lbs"),
)
UNIT_VALUE_WORDS = ("cholesterol", "glucose")
UNIT_VALUE_LIMIT = 50.0

DIAGNOSIS_WORDS = ("diagnosis", "condition", "disease")

# Fixed values: (category, trigger type or None for any issue, kind, recommendation, priority).
ADVICE = (
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
ADVICE_TEXT = {
    "missing_data_handling": "Decide how to treat missing cells: impute, drop or keep apart",
    "data_type_standardisation": "Give each column a single data type",
    "duplicate_removal": "Drop repeated rows before analysis",
    "outlier_treatment": "Look into values beyond the interquartile fences",
    "validate_range_consistency": "Check values against realistic ranges on entry",
    "data_validation": "Check field formats on entry",
    "clinical_range_validation": "Check measurements against clinical ranges",
    "acquire_recent_data": "Obtain more recent records",
    "standardise_australian_units": "Convert measurements to the local units",
    "improve_geographical_representation": "Add records from the states not covered",
}


# Fixed value: cells beyond so many interquartile ranges from the quartiles are outliers.
FENCE = 1.5
# Fixed value: the first-rows rules look at so many rows.
FIRST_ROWS = 100

Ladder = Sequence[tuple[float, str, int]]


@dataclass(frozen=True)
class Rules:
    """Every threshold, range, name part and deduction of the quality report.

    Ladders hold ``(share in per cent above which a step applies, severity, deduction)``,
    the highest share first, at most three steps.  ``replace`` from ``dataclasses`` makes a
    variant of the default rules.
    """

    missing: Ladder = MISSING_LADDER
    incomplete: Ladder = INCOMPLETE_LADDER
    incomplete_share: float = 0.5
    duplicates: Ladder = DUPLICATE_LADDER
    outliers: Ladder = OUTLIER_LADDER
    fence: float = FENCE
    health: Ladder = HEALTH_LADDER
    any_major: Ladder = ANY_MAJOR
    any_minor: Ladder = ANY_MINOR
    ages: Sequence[tuple[float, str, str, int]] = AGE_LADDER
    ratings: Sequence[tuple[float, str]] = RATINGS
    best_rating: str = BEST_RATING
    measurements: Sequence[Measurement] = MEASUREMENTS
    person_ranges: Sequence[Measurement] = PERSON_RANGES
    share_words: Sequence[str] = SHARE_WORDS
    share_limit: float = SHARE_LIMIT
    states: Sequence[str] = STATES
    state_count: int = STATE_COUNT
    state_words: Sequence[str] = STATE_WORDS
    state_deductions: tuple[int, int] = (2, 1)
    year_column: str = "Year"
    year_deduction: int = 1
    units: Sequence[tuple[str, str, str]] = UNITS
    unit_deduction: int = 1
    unit_value_words: Sequence[str] = UNIT_VALUE_WORDS
    unit_value_limit: float = UNIT_VALUE_LIMIT
    unit_values: Ladder = ((50.0, "major", 5),)
    diagnosis_words: Sequence[str] = DIAGNOSIS_WORDS
    diagnoses: Ladder = ((50.0, "minor", 1),)
    first_rows: int = FIRST_ROWS
    advice: Sequence[tuple[str, str | None, str, str, str]] = ADVICE
    advice_text: Mapping[str, str] = field(default_factory=lambda: dict(ADVICE_TEXT))

    def __post_init__(self):
        for name in ("missing", "incomplete", "duplicates", "outliers", "health", "any_major", "any_minor", "unit_values", "diagnoses"):
            steps = getattr(self, name)
            limits = [s[0] for s in steps]
            if not 1 <= len(steps) <= 3 or limits != sorted(limits, reverse=True):
                raise ValueError(f"{name}: one to three steps, the highest share first")
        for m in (*self.measurements, *self.person_ranges):
            if m.low > m.high:
                raise ValueError(f"{m.name}: {m.low} is above {m.high}")


DEFAULT = Rules()


def columns_with(names: Sequence[str], words: Sequence[str], match: str = "substring") -> list[str]:
    """Columns whose lower-cased name contains one of the words; ``token`` matches whole parts only."""
    if match not in ("substring", "token"):
        raise ValueError(f"unknown match: {match}")
    out = []
    for n in names:
        low = n.lower()
        if match == "substring":
            hit = any(w in low for w in words)
        else:
            hit = any(re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", low) for w in words)
        if hit:
            out.append(n)
    return out


def first_named(names: list[str], exact: str, word: str, fold: bool = False) -> str | None:
    """The column called ``exact``, else the first whose name contains ``word``."""
    if exact in names:
        return exact
    return next((n for n in names if word in (n.lower() if fold else n)), None)


def dated_columns(names: list[str]) -> list[str]:
    return [n for n in names if "date" in n.lower() or "year" in n.lower()]
