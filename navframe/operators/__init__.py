"""DataFrame -> DataFrame operators."""

from navframe.operators.delta import dedup_new_rows, first_write_wins, new_rows
from navframe.operators.enrich import nav_enriched, nav_enriched_single_pass
from navframe.operators.ingest import distinct_schemes, new_nav_rows, new_schemes
from navframe.operators.joins import broadcast_if_small, estimated_size_bytes
from navframe.operators.metrics import (
    annualized_volatility,
    cagr,
    daily_volatility,
    first_last_nav,
    join_metrics,
    ranked_nav,
    return_stats,
    scheme_metrics,
    scheme_metrics_joined,
    sharpe_ratio,
    valid_scheme_nav,
    valid_schemes,
)
from navframe.operators.returns import (
    daily_return_5y,
    lag_features,
    lookback,
    moving_averages,
    return_features,
    single_return,
)

__all__ = [
    "annualized_volatility",
    "broadcast_if_small",
    "cagr",
    "daily_return_5y",
    "daily_volatility",
    "dedup_new_rows",
    "distinct_schemes",
    "estimated_size_bytes",
    "first_last_nav",
    "first_write_wins",
    "join_metrics",
    "lag_features",
    "lookback",
    "moving_averages",
    "nav_enriched",
    "nav_enriched_single_pass",
    "new_nav_rows",
    "new_rows",
    "new_schemes",
    "ranked_nav",
    "return_features",
    "return_stats",
    "scheme_metrics",
    "scheme_metrics_joined",
    "sharpe_ratio",
    "single_return",
    "valid_scheme_nav",
    "valid_schemes",
]
