"""Continuous parsing of newly fetched pages."""

from pagequarry.streaming.ingest import start_ingest

__all__ = ["start_ingest"]
