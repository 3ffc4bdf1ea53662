"""Column functions over HTML strings and URLs."""

from pagequarry.functions.html import (
    content_html,
    href_values,
    html_lang,
    link_targets,
    page_h1,
    page_title,
    unquoted,
    unquoted_value,
    visible_text,
)
from pagequarry.functions.url import canonical_url, url_host

__all__ = [
    "canonical_url",
    "content_html",
    "href_values",
    "html_lang",
    "link_targets",
    "page_h1",
    "page_title",
    "unquoted",
    "unquoted_value",
    "url_host",
    "visible_text",
]
