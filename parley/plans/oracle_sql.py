"""Independent DuckDB SQL for the SQL-expressible queries.

Written from the operator semantics, not generated from the Spark plans. RE2 has
no look-ahead, so dialogues are split by inserting a separator before each marker.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.tables import ROLE_MARKERS, SUFFIXES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "||".join(f"chr({ord(c)})" for c in P.PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def redact(x: str) -> str:
    e = f"regexp_replace({x}, {_q(P.EMAIL_PATTERN)}, {_q(P.EMAIL_PLACEHOLDER)}, 'g')"
    p = f"regexp_replace({e}, {_q(P.PHONE_PATTERN)}, {_q(P.PHONE_PLACEHOLDER)}, 'g')"
    s = f"regexp_replace({p}, {_q(P.SSN_PATTERN)}, {_q(P.SSN_PLACEHOLDER)}, 'g')"
    return f"regexp_replace({s}, {_q(P.AMOUNT_PATTERN)}, {_q(P.AMOUNT_PLACEHOLDER)}, 'gi')"


def n_matches(x: str, pattern: str, ci: bool = False) -> str:
    opt = ", 0, 'i'" if ci else ""
    return f"CAST(len(regexp_extract_all({x}, {_q(pattern)}{opt})) AS BIGINT)"


def money_terms(x: str) -> str:
    lx = f"lower({x})"
    kws = " + ".join(
        f"((length({lx}) - length(replace({lx}, {_q(k)}, ''))) // {len(k)})" for k in P.MONEY_KEYWORDS
    )
    return f"CAST(({kws}) + {n_matches(x, P.AMOUNT_PATTERN, True)} AS BIGINT)"


def is_request(x: str) -> str:
    t = strip(f"lower({x})")
    kws = " OR ".join(f"contains({t}, {_q(k)})" for k in P.REQUEST_KEYWORDS)
    return f"(ends_with({t}, '?') OR {kws} OR regexp_matches({t}, {_q(P.REQUEST_PHRASE_PATTERN)}))"


_marker_case = "CASE role " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in ROLE_MARKERS.items()) + " ELSE '' END"
_suffix_list = "[" + ", ".join(_q(s) for s in SUFFIXES) + "]"

DECORATED_THREADS = f"""
decorated_pieces AS (
  SELECT conv_id, turn,
         {_marker_case} || text || {_suffix_list}[
           (CASE WHEN ((conv_id % 2 = 1) <> (conv_id % 10 = 3)) OR ((conv_id + turn) % 5 = 0)
                 THEN (conv_id * 7 + turn * 3) % 10 ELSE 8 END) + 1] AS piece
  FROM conversations
),
threads AS (
  SELECT string_agg(piece, ' ' ORDER BY turn) AS dialogue,
         CAST(NULL AS VARCHAR) AS type,
         CAST(conv_id % 2 AS INTEGER) AS label,
         conv_id AS orig_index
  FROM decorated_pieces GROUP BY conv_id
)"""

_HEAD = "^(caller|receiver):"
TURNS = f"""{DECORATED_THREADS},
split_parts AS (
  SELECT orig_index, label, type,
         unnest(list_transform(
           string_split(regexp_replace({strip("coalesce(dialogue, 'nan')")}, '(caller:|receiver:)', chr(1) || '\\1', 'gi'), chr(1)),
           lambda x, i: {{'p': {strip('x')}, 'i': i}})) AS s
  FROM threads
),
raw_turns AS (
  SELECT orig_index, label, type, s.p AS part,
         CAST(row_number() OVER (PARTITION BY orig_index ORDER BY s.i) - 1 AS INTEGER) AS turn_index
  FROM split_parts WHERE s.p <> ''
),
turns AS (
  SELECT printf('thread_%06d', orig_index) AS thread_id, orig_index, label AS thread_label, type, turn_index,
         CASE WHEN regexp_matches(part, '{_HEAD}', 'i') THEN lower(regexp_extract(part, '{_HEAD}', 1, 'i'))
              ELSE 'unknown' END AS speaker_role,
         {redact(f"CASE WHEN regexp_matches(part, '{_HEAD}', 'i') THEN " + strip(f"regexp_replace(part, '{_HEAD}', '', 'i')") + " ELSE part END")} AS message_text
  FROM raw_turns
)"""

FEATURES = f"""{TURNS},
features AS (
  SELECT thread_id, orig_index, thread_label, type,
         CAST(count(*) AS BIGINT) AS turn_count,
         CAST(sum({n_matches('message_text', P.URL_PATTERN, True)}) AS BIGINT) AS aggregate_num_urls,
         CAST(sum({money_terms('message_text')}) AS BIGINT) AS aggregate_money_terms,
         CAST(count(*) FILTER (WHERE {is_request('message_text')}) AS DOUBLE) / greatest(1, count(*)) AS ratio_request_messages
  FROM turns GROUP BY thread_id, orig_index, thread_label, type
)"""


def with_features(select: str) -> str:
    return f"WITH {FEATURES}\n{select}"


def with_turns(select: str) -> str:
    return f"WITH {TURNS}\n{select}"
