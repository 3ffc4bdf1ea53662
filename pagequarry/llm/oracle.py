"""SQL of the newer queries, which repeats parts and is put together from them."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit: the reversed polynomial is 0xEDB88320."""
    steps = f"flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split({text}, '')])"
    shift = "xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {shift}), 4294967295)"


def _edit(state: str, cost: str, edit: str, line: str) -> str:
    return (
        f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
        f"'t': list_append({state}.t, {line})}} END"
    )


def _deleted(state: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 3, 'a': {state}.a || 'D', 't': {state}.t}} END"


def _best(*offers: str) -> str:
    """The least by cost, then audit; fields of a struct are compared in turn."""
    return f"list_sort(list_filter([{', '.join(offers)}], lambda x: x IS NOT NULL))[1]"


def _stay(states: list[str], to: str, initial: str) -> list[str]:
    """Keeping and giving a role lead from ``states`` to a turn of the role ``to``."""
    kept = [
        f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(s, 'extra', 'K', 'line')} END" for s in states
    ]
    given = [
        f"CASE WHEN NOT gone THEN {_edit(s, '2 + extra', 'R', chr(39) + to + ':' + chr(39) + ' || text')} END"
        for s in states
    ]
    return kept + given


_EMPTY = "CAST([] AS VARCHAR[])"

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
),
dealt AS (SELECT *, {_crc32('k')} % 20 AS d FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE d <> 0
),
placed AS (
  SELECT *, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p
  FROM damaged
),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY p) AS before
  FROM placed
),
turns AS (
  SELECT conv_id, p, initial, text, role || ':' || text AS line,
         coalesce(fault IN ('blank', 'duplicate'), false) AS gone,
         CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra
  FROM judged
),
none AS (SELECT {{'c': 0::BIGINT, 'a': '', 't': {_EMPTY}}} AS s0),
program AS (
  SELECT i.conv_id, 0::BIGINT AS p, s0, CASE WHEN false THEN s0 END AS s1,
         {_edit('s0', '2', 'I', "'user:'")} AS s2,
         {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3
  FROM (SELECT DISTINCT conv_id FROM turns) i, none
  UNION ALL
  SELECT conv_id, p, d0, d1, i2, {_best('d3', _edit('i2', '2', 'I', "'assistant:'"))}
  FROM (
    SELECT *, {_best('d2', *(_edit(s, '2', 'I', "'user:'") for s in ('d0', 'd1', 'd3')))} AS i2
    FROM (
      SELECT q.conv_id, turns.p,
             {_deleted('s0')} AS d0,
             {_best(_deleted('s1'), f"CASE WHEN NOT gone AND initial = 's' THEN {_edit('s0', 'extra', 'K', 'line')} END")} AS d1,
             {_best(_deleted('s2'), *_stay(['s0', 's1', 's3'], 'user', 'u'))} AS d2,
             {_best(_deleted('s3'), *_stay(['s2'], 'assistant', 'a'))} AS d3
      FROM program q JOIN turns ON turns.conv_id IS NOT DISTINCT FROM q.conv_id AND turns.p = q.p + 1
    )
  )
),
ended AS (
  SELECT conv_id, {_best('arg_max(s0, p)', 'arg_max(s3, p)')} AS best FROM program GROUP BY conv_id
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id"""

CONVERSATION_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list(t ORDER BY p) AS ts FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, {_crc32('o.conv_id::VARCHAR')} % 4 AS h,
         list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) AS ts
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
),
starts AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS d, ts FROM rebuilt),
nodes AS (
  SELECT ts[1:d] AS seq, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '') AS ends
  FROM starts GROUP BY ts[1:d]
),
valued AS (
  SELECT *, (n_convs - 1) * coalesce(len(regexp_extract_all(seq[depth].text, '[^\x20\x09-\x0D]+')), 0) AS saved
  FROM nodes
),
children AS (
  SELECT seq[1:depth - 1] AS seq, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY seq[1:depth - 1]
),
above AS (
  SELECT v.seq[1:a] AS seq, count(*) FILTER (c.n IS NULL) AS leaves, sum(saved) AS saved
  FROM (SELECT seq, saved, unnest(range(0, depth + 1)) AS a FROM valued) v
  LEFT JOIN children c ON c.seq = v.seq
  GROUP BY v.seq[1:a]
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
       CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens,
       sha256(x.ends) AS ends_sha256
FROM valued x JOIN above a ON a.seq = x.seq
LEFT JOIN children c ON c.seq = x.seq
LEFT JOIN nodes p ON x.depth > 0 AND p.seq = x.seq[1:x.depth - 1]"""
