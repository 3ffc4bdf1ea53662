"""HTML fields as Column expressions.

Every function is a composition of built-in functions: no Python runs per row.
All but ``unquoted`` and the text of pages with a ``<`` in the body of a text
element, whose lambdas Spark interprets, stay inside whole-stage code generation.

The patterns walk a page the way a browser splits it: a comment, an element whose
body is no markup, a tag with its quoted attribute values, or plain text. So a
``<title>`` inside a comment is not a title, a ``<script>`` inside a title is text,
and a ``>`` inside a quoted value does not end a tag. Nothing has to be closed; an
open element runs to the end of the page.

Repetitions are possessive, so a pattern does not return to what it has passed
nor recurse per character, and hostile or huge pages keep linear cost and
constant stack depth.

Character entities stay encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements whose body is never markup. A browser
# shows that of the second kind as it stands, and nothing of the first.
RAW_ELEMENTS = ("script", "style", "iframe", "noembed", "noframes")
TEXT_ELEMENTS = ("title", "textarea", "xmp")
# A choice: elements that do not break a line or a word.
INLINE_ELEMENTS = (
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
    "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
)

_NAME_END = r"(?=[\s/>]|\z)"
# What follows a tag name, up to the closing '>' or the end of the page.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"?+|'[^']*+'?+)?+)*+>?+"""
# The pieces below come after a '<'.
_COMMENT = r"!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>)?+)"
_TAG = rf"[a-z/!?]{_ATTRIBUTES}"


def _with_body(name: str) -> str:
    return (
        rf"{name}{_NAME_END}{_ATTRIBUTES}"
        rf"(?:[^<]++|<(?!/{name}{_NAME_END}))*+(?:</{name}{_ATTRIBUTES})?+"
    )


_RAW = "|".join(map(_with_body, RAW_ELEMENTS))
_TEXT = "|".join(map(_with_body, TEXT_ELEMENTS))


def _up_to(name: str) -> str:
    """Everything before the first tag called ``name``, piece by piece."""
    return rf"(?:[^<]++|<(?!{name}{_NAME_END})(?:{_COMMENT}|{_RAW}|{_TEXT}|{_TAG})?+)*+"


def _open(name: str) -> str:
    """From the start of the page through the first ``name`` tag."""
    return rf"(?is)\A{_up_to(name)}<{name}{_ATTRIBUTES}"


_TITLE = rf"{_open('title')}((?:[^<]++|<(?!/title{_NAME_END}))*+)"
# Any other heading tag closes an open heading.
_H1 = rf"{_open('h1')}({_up_to('/?h[1-6]')})"


def _through_last_end(name: str) -> str:
    """After the first ``name`` tag: everything before the last closing one.

    Up to the next closing tag, then on past it as long as another one follows, so
    that nested elements stay whole.
    """
    segment = _up_to(f"/{name}")
    return rf"{_open(name)}({segment}(?:</{name}{_ATTRIBUTES}{segment}(?=<))*+)"


_ARTICLE = _through_last_end("article")
_BODY = _through_last_end("body")

_ATTRIBUTE_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
_OTHER_ATTRIBUTE = (
    r"[\s/]*+(?!{name}\s*+=)[^\s/>=]++(?:\s*+=\s*+" + _ATTRIBUTE_VALUE + r"?+)?+"
)


def _attribute(tag: str, name: str) -> str:
    """Text after '<': a ``tag`` with its ``name`` value, quotes included, captured."""
    others = _OTHER_ATTRIBUTE.format(name=name)
    return (
        rf"{tag}(?=[\s/])(?:{others})*+"
        rf"[\s/]*+{name}\s*+=\s*+({_ATTRIBUTE_VALUE}){_ATTRIBUTES}"
    )


_HTML_LANG = rf"(?is)\A{_up_to('html')}<{_attribute('html', 'lang')}"
# The other alternatives consume what a link must not be found in; they capture
# nothing.
_LINK = rf"(?is)<(?:{_COMMENT}|{_RAW}|{_TEXT}|{_attribute('a', 'href')}|{_TAG})"
# Text takes two passes. The first drops what leaves no gap; of any other tag it
# keeps "<" (group 2) and the character behind it (group 1) as a mark, which the
# second pass turns into a space. Right after a "<" of the text nothing is dropped
# without a mark: that "<" and the text behind would together look like one.
_INLINE_TAG = rf"/?+(?:{'|'.join(INLINE_ELEMENTS)}){_NAME_END}{_ATTRIBUTES}"
_GAPLESS_OR_TAG = (
    rf"(?is)<(?:(?<!<<)(?:{_COMMENT}|{_RAW}|{_INLINE_TAG})"
    # From the first group on this cannot fail, so no group keeps a stale value.
    rf"|(?=([a-z/!?]))(?<=(<))(?:{_COMMENT}|{_RAW}|{_TAG}))"
)
_MARK = r"<[a-zA-Z/!?]"
# These passes would take a "<" in the body of a text element for a tag. A page with
# such a body is found by walking over all pieces but that, and is taken to pieces.
_TEXT_START = rf"(?:{'|'.join(TEXT_ELEMENTS)}){_NAME_END}"
_PLAIN_TEXT = "|".join(
    rf"{name}{_NAME_END}{_ATTRIBUTES}[^<]*+(?:</{name}{_NAME_END}{_ATTRIBUTES}|\z)"
    for name in TEXT_ELEMENTS
)
_HOLDS_MARKUP_AS_TEXT = (
    rf"(?is)\A(?:[^<]++|<(?:{_PLAIN_TEXT}|(?!{_TEXT_START})(?:{_COMMENT}|{_RAW}|{_TAG})?+))*+"
    rf"<{_TEXT_START}"
)
# Most pages have such elements in their plainest form only and need no walk.
_MAY_HOLD_MARKUP_AS_TEXT = rf"(?i)<({'|'.join(TEXT_ELEMENTS)})(?!\s*+>[^<]*+</\1\s*+>)"
_PIECE = rf"(?is)<(?:{_COMMENT}|{_RAW}|{_TEXT}|{_TAG})|[^<]++|<"
_GAPLESS_PIECE = rf"(?is)\A<(?:{_COMMENT}|{_RAW}|{_INLINE_TAG})\z"
_TEXT_PIECE = (
    rf"(?is)\A<({'|'.join(TEXT_ELEMENTS)}){_NAME_END}{_ATTRIBUTES}"
    rf"((?:[^<]++|<(?!/\1{_NAME_END}))*+)"
)
# Whitespace that is not already a single space.
_WIDE_SPACE = r"\s(?:\s++|(?<! ))"
_QUOTES = r"""(?s)\A(["'])(.*)\1\z"""


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WIDE_SPACE, " "))


def _null_if_empty(text: Column) -> Column:
    # Spark shares the text between both uses, except inside a conditional branch.
    return F.nullif(text, F.lit(""))


def _unquote(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, _QUOTES, "$2"), F.lit(" \t\r\n\f"))


def visible_text(html: Column) -> Column:
    """Text of the page, title included, without code, comments and tags; spaces collapsed."""
    marked = F.regexp_replace(html, _GAPLESS_OR_TAG, "$2$1")
    text = F.regexp_replace(marked, _MARK, " ")
    pieces = F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))
    from_pieces = F.array_join(F.transform(pieces, _piece_text), "")
    to_pieces = html.rlike(_MAY_HOLD_MARKUP_AS_TEXT) & html.rlike(_HOLDS_MARKUP_AS_TEXT)
    return _collapse(F.when(to_pieces, from_pieces).otherwise(text))


def _piece_text(piece: Column) -> Column:
    return (
        F.when(piece.rlike(_GAPLESS_PIECE), "")
        .when(
            piece.rlike(rf"(?is)\A<{_TEXT_START}"),
            F.concat(F.lit(" "), F.regexp_extract(piece, _TEXT_PIECE, 2), F.lit(" ")),
        )
        .when(piece.rlike(rf"\A{_MARK}"), " ")
        .otherwise(piece)
    )


def page_title(html: Column) -> Column:
    """Text of the first ``<title>``; null if absent or empty."""
    return _null_if_empty(_collapse(F.regexp_extract(html, _TITLE, 1)))


def page_h1(html: Column) -> Column:
    """Text of the first ``<h1>``, inner tags removed; null if absent or empty."""
    return _null_if_empty(visible_text(F.regexp_extract(html, _H1, 1)))


def html_lang(html: Column) -> Column:
    """``lang`` of the ``<html>`` tag in lower case; null if absent or empty."""
    return _null_if_empty(F.lower(_unquote(F.regexp_extract(html, _HTML_LANG, 1))))


def href_values(html: Column) -> Column:
    """Array of the ``href`` values of all ``<a>`` tags as written, quotes included."""
    return F.array_remove(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), "")


def unquoted_value(value: Column) -> Column:
    """An attribute value without its quotes and outer spaces."""
    return _unquote(value)


def unquoted(values: Column) -> Column:
    """Array of attribute values without their quotes and outer spaces."""
    return F.transform(values, _unquote)


def link_targets(html: Column) -> Column:
    """Array of the link targets of all ``<a>`` tags, in page order."""
    return unquoted(href_values(html))


def _first_body(html: Column, pattern: str) -> Column:
    """What ``pattern`` captures, null if that is empty; the pattern is run once."""
    bodies = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.get(F.array_remove(bodies, ""), F.lit(0))


def content_html(html: Column) -> Column:
    """Markup that counts as the page's content.

    From the first ``<article>`` to the last ``</article>``; without an article
    the ``<body>``, and without that the whole page.
    """
    return F.coalesce(_first_body(html, _ARTICLE), _first_body(html, _BODY), html)
