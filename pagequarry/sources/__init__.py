"""Page tables."""

from pagequarry.sources.pages import (
    PAGES_SCHEMA,
    read_in_small_batches,
    read_pages,
    stream_pages,
)

__all__ = ["PAGES_SCHEMA", "read_in_small_batches", "read_pages", "stream_pages"]
