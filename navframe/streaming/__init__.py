"""Structured Streaming ingest of landed NAV documents."""

from navframe.streaming.nav_ingest import nav_document_stream, start_nav_ingest

__all__ = ["nav_document_stream", "start_nav_ingest"]
