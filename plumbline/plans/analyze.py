"""The whole analysis of one table, as named DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import settle
from plumbline.operators.correlation import correlated_pairs, correlation_matrix, pearson_pairs
from plumbline.operators.frequency import categorical_profile, categorical_value_counts, frequency
from plumbline.operators.histogram import histogram
from plumbline.operators.infer import infer_types, type_map
from plumbline.operators.quality import quality_report
from plumbline.operators.quantiles import quartile_profile
from plumbline.operators.summary import column_summary, moments, overview
from plumbline.operators.temporal import date_pattern, temporal_profile, temporal_stats
from plumbline.plans import insights as rows
from plumbline.plans import profile, recommend


def dataset_stats(df: DataFrame, types: Mapping[str, str]) -> dict[str, DataFrame]:
    """Statistics by column type: moments, quartiles and histograms of numeric columns,
    frequencies of categorical ones, basic statistics of temporal ones."""
    numeric = [c for c, t in types.items() if t == "numeric"]
    times = [c for c, t in types.items() if t in ("temporal", "date")]
    rest = [c for c in types if c not in numeric and c not in times]
    out: dict[str, DataFrame] = {}
    if numeric:
        out["moments"] = moments(df, numeric)
        out["quartiles"] = quartile_profile(df, numeric)
        out["histograms"] = histogram(df, numeric)
    if rest:
        out["frequencies"] = frequency(df, rest)
    if times:
        out["temporal"] = temporal_stats(df, times)
    return out


def dataset_metadata(df: DataFrame, types: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Size, per-column features, correlations, insights and their recommendations."""
    types = dict(types or type_map(df, "metadata"))
    numeric = [c for c, t in types.items() if t == "numeric"]
    times = [c for c, t in types.items() if t in ("temporal", "date")]
    rest = [c for c in types if c not in numeric and c not in times]
    features = profile.feature_profile(df, types)
    pairs = settle(correlated_pairs(pearson_pairs(df, numeric)))
    found = rows.insights(df, features, pairs)
    out = {
        "dataset": df.agg(F.count(F.lit(1)).alias("record_count")).withColumn("feature_count", F.lit(len(types))),
        "features": features,
        "correlated_pairs": pairs,
        "insights": found,
        "recommendations": rows.insight_recommendations(found),
    }
    if numeric:
        out["numeric_features"] = profile.numeric_profile(df, numeric)
        out["histograms"] = histogram(df, numeric)
    if len(numeric) > 1:
        out["correlations"] = correlation_matrix(df, numeric, zero_variance="zero")
    if rest:
        out["categorical_features"] = categorical_profile(df, rest)
        out["value_counts"] = categorical_value_counts(df, rest)
    if times:
        out["temporal_features"] = temporal_profile(df, times)
        out["date_patterns"] = date_pattern(df, times)
    return out


def analyze(
    df: DataFrame,
    as_of_year: int,
    policy: str = "default",
    order_by: Sequence[str] | None = None,
    persist: bool = False,
) -> dict[str, DataFrame]:
    """Every result table of the analysis, over all rows.

    ``persist`` keeps the input on executor disks while the results are read, which pays off
    when the input is costly to scan (text files); the caller unpersists ``input``.
    """
    if persist:
        df = df.persist(StorageLevel.DISK_ONLY)
    types = type_map(df, policy, order_by)
    numeric = [c for c, t in types.items() if t == "numeric"]
    out = {
        "input": df,
        "summary": column_summary(df),
        "overview": overview(df),
        "types": infer_types(df, policy, order_by=order_by),
    }
    out.update({f"stats_{k}": v for k, v in dataset_stats(df, types).items()})
    if len(numeric) > 1:
        out["correlation_matrix"] = correlation_matrix(df, numeric)
    out.update({f"metadata_{k}": v for k, v in dataset_metadata(df, types).items()})
    out.update({f"quality_{k}": v for k, v in quality_report(df, as_of_year, order_by).items()})
    out["charts"] = recommend.optimal_charts(profile.chart_profile(df, types))
    return out
