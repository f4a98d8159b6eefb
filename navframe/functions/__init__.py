from navframe.functions.dates import as_of_col, format_day_first, lookback_start, parse_day_first
from navframe.functions.finance import annualize, cagr_pct, pct_change, sharpe, years_between

__all__ = [
    "annualize",
    "as_of_col",
    "cagr_pct",
    "format_day_first",
    "lookback_start",
    "parse_day_first",
    "pct_change",
    "sharpe",
    "years_between",
]
