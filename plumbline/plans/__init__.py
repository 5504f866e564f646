from plumbline.plans.analyze import analyze, dataset_metadata, dataset_stats
from plumbline.plans.charts import chart_data
from plumbline.plans.insights import insight_recommendations, insights
from plumbline.plans.profile import chart_profile, feature_profile, numeric_profile
from plumbline.plans.recommend import (
    by_category,
    optimal_charts,
    progressive_charts,
    recommend_charts,
    select_chart,
    select_chart_for,
    suggested_charts,
)

__all__ = [
    "analyze",
    "by_category",
    "chart_data",
    "chart_profile",
    "dataset_metadata",
    "dataset_stats",
    "feature_profile",
    "insight_recommendations",
    "insights",
    "numeric_profile",
    "optimal_charts",
    "progressive_charts",
    "recommend_charts",
    "select_chart",
    "select_chart_for",
    "suggested_charts",
]
