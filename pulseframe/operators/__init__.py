from pulseframe.operators.correlation import correlation_matrix, correlation_pairs, heatmap, pair_samples, search_pairs
from pulseframe.operators.daily import daily_partials, daily_reduce, daily_wide, merge_partials, pivot_daily
from pulseframe.operators.overview import daily_overview, overview_from_wide
from pulseframe.operators.ranking import latest_user, newest_days, ordered_pairs, pair_rank, top_pairs, users
from pulseframe.operators.rolling import rolling_frame, rolling_zscore

__all__ = [
    "correlation_matrix",
    "correlation_pairs",
    "daily_overview",
    "daily_partials",
    "daily_reduce",
    "daily_wide",
    "heatmap",
    "latest_user",
    "merge_partials",
    "newest_days",
    "ordered_pairs",
    "overview_from_wide",
    "pair_rank",
    "pair_samples",
    "pivot_daily",
    "rolling_frame",
    "rolling_zscore",
    "search_pairs",
    "top_pairs",
    "users",
]
