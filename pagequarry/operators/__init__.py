"""Operators: DataFrame in, DataFrame out.

``parse_pages`` turns raw pages into one parsed row each. All other operators
read the parsed columns, so they run on ``parse_pages(pages)`` directly, where
Catalyst drops every field they do not use, or on a stored parsed table, where
they need not touch the HTML again.
"""

from pagequarry.operators.dedup import content_groups, url_groups
from pagequarry.operators.hosts import host_summary
from pagequarry.operators.parse import page_fields, page_links, page_text, parse_pages, url_canonical

__all__ = [
    "content_groups",
    "host_summary",
    "page_fields",
    "page_links",
    "page_text",
    "parse_pages",
    "url_canonical",
    "url_groups",
]
