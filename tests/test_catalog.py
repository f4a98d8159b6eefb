"""Catalogue contract: coverage of the SURVEY query names, explicit column names."""

import pytest
from conftest import SF001

import __spark_entry__ as E
from navframe.plans.catalog import CATALOG

QUERIES = {name: E.queries()[name] for name in CATALOG}

# query names SURVEY section 2 asks for
SURVEY_NAMES = """
csv_scan scheme_list_parse nav_json_explode weather_flatten people_explode total_rows
append_sink overwrite_sink new_schemes new_nav_rows parse_nav_date
daily_return weekly_return monthly_return rolling_return_30d rolling_return_90d
return_features nav_enriched lookback_3y daily_return_5y valid_schemes first_last_nav
delta_anti_join valid_scheme_nav scheme_metrics return_stats cagr sharpe_ratio
daily_volatility annualized_volatility lag_features moving_averages ranked_nav
schemes_sorted preview
portfolio_allocation portfolio_nav_history max_drawdown portfolio_metrics diversification
portfolio_flags portfolio_decision sequence_features document_chunks embedding_topk
""".split()

# documented in README "Not built, or re-aimed"
NOT_BUILT = {"jdbc_scan", "jdbc_partitioned_scan"}


def test_survey_names_registered():
    missing = [n for n in SURVEY_NAMES if n not in QUERIES]
    assert missing == []
    assert not NOT_BUILT & set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_are_named_and_unique(spark, name):
    cols = QUERIES[name](spark, SF001).columns
    assert len(cols) == len(set(cols)), cols
    assert all("(" not in c and c == c.lower() for c in cols), cols
