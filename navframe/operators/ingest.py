"""Scheme and NAV ingest (E4, E5): parsed payload rows -> rows to append.

First write wins inside a batch (payload order), stored keys win over the
batch, NULL keys never enter. All set work, no per-scheme lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from navframe.operators.delta import dedup_new_rows, first_write_wins
from navframe.sources.json_docs import ORDER

SCHEME_KEYS = ["scheme_code"]
NAV_KEYS = ["scheme_code", "nav_date"]
SCHEME_ORDER = ["listing", "page", "pos"]
NAV_ORDER = ORDER


def distinct_schemes(parsed: DataFrame) -> DataFrame:
    """One row per scheme code, the first in payload order."""
    return first_write_wins(parsed.filter("scheme_code IS NOT NULL"), SCHEME_KEYS, SCHEME_ORDER, keep_order=False)


def new_schemes(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """K3 + J2: schemes from the list whose code is not stored yet."""
    return dedup_new_rows(parsed, stored, SCHEME_KEYS, SCHEME_ORDER)


def new_nav_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """K4 + J3: NAV rows whose ``(scheme_code, nav_date)`` is not stored yet.

    ``rows`` comes from :func:`navframe.sources.json_docs.explode_nav_documents`
    (payload order = file, split of the file, line, position in ``data``).
    """
    # the raw texts only matter for quarantine, which happens before
    slim = rows.drop(*[c for c in ("line_key", "_date_text", "_nav_text") if c in rows.columns])
    return dedup_new_rows(slim, stored, NAV_KEYS, NAV_ORDER)
