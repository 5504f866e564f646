"""Insight rows: filters over the feature profile and the correlated pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_text
from plumbline.operators.columns import local_table

# Fixed values: (trigger section, trigger kind, trigger severity, advice, priority).
ADVICE = (
    ("quality_issues", None, "high", "data_cleaning", "high"),
    ("correlation_insights", "strong_correlation", None, "feature_selection", "medium"),
    ("distribution_insights", "skewed_distribution", None, "transformation", "medium"),
    ("distribution_insights", "high_cardinality", None, "feature_engineering", "medium"),
)
ADVICE_TEXT = {
    "data_cleaning": "Deal with the most severe quality findings first",
    "feature_selection": "Drop one of each pair of strongly correlated columns",
    "transformation": "Transform skewed columns before modelling",
    "feature_engineering": "Merge rare values of columns with very many categories",
}


def _rows(
    source: DataFrame,
    section: str,
    kind: Column | str,
    description: Column,
    feature: Column | None = None,
    severity: Column | None = None,
    advice: Column | str | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    as_col = lambda v: none if v is None else (F.lit(v) if isinstance(v, str) else v)
    return source.select(
        F.lit(section).alias("section"),
        as_col(feature).alias("feature"),
        as_col(kind).alias("kind"),
        as_col(severity).alias("severity"),
        description.alias("description"),
        as_col(advice).alias("recommendation"),
    )


def _severity(pct: Column, high: float, medium: float) -> Column:
    return F.when(pct > high, "high").when(pct > medium, "medium").otherwise("low")


def insights(df: DataFrame, features: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(section, feature, kind, severity, description, recommendation)``.

    ``features`` from ``feature_profile``, ``pairs`` from ``correlated_pairs``.
    """
    column = F.col("column")
    sizes = features.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("type") == "numeric").alias("numeric"),
        F.count_if(F.col("type") == "categorical").alias("categorical"),
        F.count_if(F.col("type").isin("temporal", "date")).alias("temporal"),
    ).withColumn("records", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    skew, r = F.col("skewness"), F.abs("correlation")
    both = F.concat_ws(", ", "feature1", "feature2")
    parts = [
        _rows(sizes, "summary", "size", F.format_string("%d records with %d columns", "records", "n")),
        _rows(
            sizes, "summary", "types",
            F.format_string("%d numeric, %d categorical and %d temporal columns", "numeric", "categorical", "temporal"),
        ),
        _rows(
            features.where("missing > 0"), "quality_issues", "missing_values",
            F.format_string('"%s": %d missing values (%s%%)', "column", "missing", fixed_text(F.col("missing_pct"))),
            column, _severity(F.round("missing_pct", 2), 20, 5),
        ),
        _rows(
            features.where((F.col("type") == "numeric") & (F.col("outliers") > 0)), "quality_issues", "outliers",
            F.format_string('"%s": %d outliers (%s%%)', "column", "outliers", fixed_text(F.col("outlier_pct"))),
            column, _severity(F.round("outlier_pct", 2), 10, 2),
        ),
        _rows(
            features.where((F.col("type") == "numeric") & (F.abs("skewness") > 1)), "distribution_insights",
            "skewed_distribution",
            F.format_string('"%s" is %s (skewness %s)', "column",
                            F.when(skew > 0, "right-skewed").otherwise("left-skewed"), fixed_text(skew)),
            column, advice=F.when(skew > 1, "Try a log transformation"),
        ),
        _rows(
            features.where((F.col("type") == "numeric") & (F.col("variance") < 0.01)), "distribution_insights",
            "low_variance", F.format_string('"%s" hardly varies (variance %s)', "column", fixed_text(F.col("variance"), 6)),
            column, advice="Unlikely to help a prediction",
        ),
        _rows(
            features.where((F.col("type") == "categorical") & (F.col("unique_values") > 100)), "distribution_insights",
            "high_cardinality", F.format_string('"%s" has %d distinct values', "column", "unique_values"),
            column, advice="Merge rare categories",
        ),
        _rows(
            features.where((F.col("type") == "categorical") & (F.round("most_pct", 2) > 80)), "distribution_insights",
            "imbalanced_categories",
            F.format_string('"%s" is mostly "%s" (%s%%)', "column", "most_frequent", fixed_text(F.col("most_pct"))),
            column, advice="Balance the classes before modelling",
        ),
        _rows(
            pairs.where(r > 0.7), "correlation_insights",
            F.when(r > 0.9, "strong_correlation").otherwise("moderate_correlation"),
            F.format_string('"%s" and "%s" correlate %sly (%s)', "feature1", "feature2", "strength", fixed_text(F.col("correlation"))),
            both, advice=F.when(r > 0.9, "Drop one of the two").otherwise("Mind multicollinearity"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def insight_recommendations(found: DataFrame) -> DataFrame:
    """``(type, priority, description)`` of the advice the insights call for."""
    table = local_table(
        found.sparkSession,
        [(*a, ADVICE_TEXT[a[3]]) for a in ADVICE],
        "section string, trigger string, level string, type string, priority string, description string",
    )
    present = found.select("section", "kind", "severity").distinct()
    hit = (
        (table["section"] == present["section"])
        & (table["trigger"].isNull() | (table["trigger"] == present["kind"]))
        & (table["level"].isNull() | (table["level"] == present["severity"]))
    )
    return table.join(present, hit, "left_semi").select("type", "priority", "description")
