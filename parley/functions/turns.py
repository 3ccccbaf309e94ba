"""Dialogue -> ordered speaker turns, as an ARRAY<STRUCT> Column (the UDTF shape).

Markers split anywhere (not word-bounded, case-insensitive); text before the first
marker belongs to speaker ``unknown``; a marker with no text keeps an empty turn;
a dialogue with no non-blank part falls back to one ``unknown`` turn holding the
raw text; a missing dialogue reads as ``nan``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import _col, null_to_text, py_strip, redact_pii

_SPLIT = P.java("(?=" + P.marker_alternation() + ")", ignore_case=True)
_HEAD = P.java("^(" + "|".join(m.rstrip(":") for m in P.SPEAKER_MARKERS) + "):", ignore_case=True)


def _to_turn(part: Column) -> Column:
    head = F.regexp_extract(part, _HEAD, 1)
    has_marker = head != F.lit("")
    return F.struct(
        F.when(has_marker, F.lower(head)).otherwise(F.lit(P.UNKNOWN_SPEAKER)).alias("speaker_role"),
        F.when(has_marker, py_strip(F.regexp_replace(part, _HEAD, ""))).otherwise(part).alias("message_text"),
    )


def split_turns(dialogue) -> Column:
    """ARRAY<STRUCT<speaker_role STRING, message_text STRING>> in dialogue order."""
    raw = null_to_text(dialogue)
    parts = F.filter(
        F.transform(F.split(py_strip(raw), _SPLIT, -1), lambda p: py_strip(p)),
        lambda p: p != F.lit(""),
    )
    turns = F.transform(parts, _to_turn)
    fallback = F.array(F.struct(F.lit(P.UNKNOWN_SPEAKER).alias("speaker_role"), raw.alias("message_text")))
    return F.when(F.size(turns) > 0, turns).otherwise(fallback)


def redact_turns(turns) -> Column:
    """Redact every turn's text; keeps the array shape (no explode, no shuffle)."""
    return F.transform(
        _col(turns),
        lambda t: F.struct(t["speaker_role"].alias("speaker_role"), redact_pii(t["message_text"]).alias("message_text")),
    )
