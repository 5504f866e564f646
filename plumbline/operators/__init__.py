from plumbline.operators.correlation import (
    chart_matrix,
    column_pairs,
    correlated_pairs,
    correlation_matrix,
    dense_matrix,
    pearson,
    pearson_pairs,
    spearman,
    spearman_pairs,
)
from plumbline.operators.duplicates import duplicate_count, duplicate_groups, duplicate_rows
from plumbline.operators.frequency import (
    cardinality,
    categorical_profile,
    categorical_value_counts,
    category_counts,
    continuity,
    distinct_values,
    frequency,
    value_counts,
)
from plumbline.operators.histogram import histogram
from plumbline.operators.infer import columns_of_type, count_by_type, infer_types, type_map
from plumbline.operators.nested import leaves
from plumbline.operators.quality import (
    domain_coverage,
    domain_matches,
    domain_violations,
    format_recommendations,
    incomplete_rows,
    issues,
    missing_by_column,
    mixed_types,
    quality_report,
    range_checks,
    recommendations,
    score_summary,
    timeliness,
)
from plumbline.operators.quantiles import (
    boxplot,
    boxplot_outliers,
    iqr_outliers,
    order_stats,
    outlier_values,
    quantiles,
    quartile_profile,
)
from plumbline.operators.reconcile import (
    new_rows,
    reconcile,
    reconcile_summary,
    union_findings,
    validate,
    validate_datasets,
)
from plumbline.operators.rules import Measurement, Rules
from plumbline.operators.sampling import adaptive_sample, random_sample, reservoir_sample, stratified_sample
from plumbline.operators.summary import (
    column_summary,
    missing_share_warnings,
    moments,
    overview,
    percentage_check,
)
from plumbline.operators.temporal import (
    date_pattern,
    downsample,
    month_share,
    temporal_profile,
    temporal_stats,
    time_gaps,
    time_series,
    weekday_share,
    year_gaps,
)

__all__ = [n for n in dir() if not n.startswith("_")]
