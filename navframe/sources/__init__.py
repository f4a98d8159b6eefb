"""Readers for landed payloads, CSV, JDBC, Parquet test tables and temp views."""

from navframe.sources.csv import preview, read_csv
from navframe.sources.json_docs import (
    explode_nav_documents,
    flatten_weather,
    parse_scheme_list,
    people_in_space,
    people_messages,
    read_nav_documents,
    read_people,
    read_scheme_pages,
    read_weather,
    split_quarantine,
)
from navframe.sources.views import count_rows, register_view

__all__ = [
    "count_rows",
    "explode_nav_documents",
    "flatten_weather",
    "parse_scheme_list",
    "people_in_space",
    "people_messages",
    "preview",
    "read_csv",
    "read_nav_documents",
    "read_people",
    "read_scheme_pages",
    "read_weather",
    "register_view",
    "split_quarantine",
]
