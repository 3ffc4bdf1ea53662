"""DuckDB SQL that each named query must agree with.

It reaches the same results another way: comments and code are cut out of the
page first and fields are then picked from what is left, URLs are taken apart by
splitting, and the kept page per URL comes from a window.
"""

from __future__ import annotations

# Its own list, so that an error in the library's shows.
_INLINE = (
    "a|abbr|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small"
    "|span|strike|strong|sub|sup|time|tt|u|var|wbr"
)


def _text(markup: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace("
        rf"{markup}, '(?i)</?({_INLINE})(\s[^>]*)?>', '', 'g'), "
        r"'<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
    )


_CLEAN = r"""
clean AS (
  SELECT page_id, url,
         regexp_replace(
           regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script.*?</script>|<style.*?</style>', '', 'g') AS markup
  FROM pages
)"""

_HOST = "lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1))"

_CANONICAL = rf"""
canonical AS (
  SELECT page_id, url,
         regexp_replace({_HOST}, '^(www|m)\.', '')
           || '/' || array_to_string(string_split(bare, '/')[4:], '/')
           || CASE WHEN len(numbers) > 0 THEN '?' || numbers[1] ELSE '' END AS canonical_url
  FROM (
    SELECT page_id, url, split_part(split_part(url, '#', 1), '?', 1) AS bare,
           list_filter(
             string_split(split_part(split_part(url, '#', 1), '?', 2), '&'),
             lambda p: regexp_full_match(p, 'page=[0-9]+')) AS numbers
    FROM pages
  )
)"""

_LANG = r"""nullif(lower(regexp_extract(markup, '(?i)<html\s[^>]*lang="([^"]*)"', 1)), '')"""

_LINKS = r"""
links AS (
  SELECT page_id, url, {lang} AS lang,
         regexp_extract_all(markup, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hrefs
  FROM clean
)""".format(lang=_LANG)

ORACLE_SQL: dict[str, str] = {
    "page_fields": rf"""
WITH {_CLEAN}
SELECT page_id,
       nullif(trim(regexp_replace(
         regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')), '') AS title,
       nullif({_text("regexp_extract(markup, '(?is)<h1[^>]*>(.*?)</h1', 1)")}, '') AS h1,
       {_LANG} AS lang,
       {_HOST} AS host
FROM clean""",
    "url_canonical": f"""
WITH {_CANONICAL}
SELECT page_id, url, canonical_url FROM canonical""",
    "page_links": f"""
WITH {_CLEAN}, {_LINKS}
SELECT page_id,
       CAST(unnest(range(len(hrefs))) AS BIGINT) AS position,
       unnest(hrefs) AS href
FROM links""",
    "page_text": f"""
WITH {_CLEAN}
SELECT page_id, {_text("markup")} AS text FROM clean""",
    "page_dedup_content": r"""
WITH content AS (
  SELECT page_id,
         sha256(regexp_extract(html, '(?is)<article[^>]*>(.*)</article', 1)) AS content_hash
  FROM pages
)
SELECT content_hash, min(page_id) AS page_id, count(*) AS n_pages
FROM content GROUP BY content_hash""",
    "page_dedup_url": f"""
WITH {_CANONICAL},
ranked AS (
  SELECT canonical_url, page_id,
         row_number() OVER (PARTITION BY canonical_url ORDER BY page_id DESC) AS place,
         count(*) OVER (PARTITION BY canonical_url) AS n_pages
  FROM canonical
)
SELECT canonical_url, page_id, n_pages FROM ranked WHERE place = 1""",
    "host_summary": f"""
WITH {_CLEAN}, {_LINKS}
SELECT {_HOST} AS host,
       count(*) AS n_pages,
       count(DISTINCT lang) AS n_languages,
       CAST(sum(len(hrefs)) AS BIGINT) AS n_links
FROM links GROUP BY 1""",
}
