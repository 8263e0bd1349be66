"""SQL functions under the names queries expect, where Spark's own names or meanings differ.

They are SQL functions, inlined by the optimiser, so they cost nothing over the expressions they stand for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

# Text of an RFC 3339 time to nanoseconds: the fraction is taken from the text, as timestamps end at microseconds. A time
# without an offset is in UTC.
_NS = """
  unix_seconds(to_timestamp(concat(regexp_extract(t, '^([^.Z+]{10}[T ][0-9:]+|[^T ]+)', 1), coalesce(nullif(regexp_extract(t, '[T ][^Z+-]*([+-][0-9]{2}:?[0-9]{2})$', 1), ''), 'Z')))) * 1000000000
  + CAST(rpad(coalesce(nullif(regexp_extract(t, '[.]([0-9]{1,9})', 1), ''), '0'), 9, '0') AS BIGINT)
"""

FUNCTIONS = {
    "to_timestamp_ns(t STRING) RETURNS BIGINT": _NS,
    "strpos(t STRING, part STRING) RETURNS INT": "locate(part, t)",
    "to_hex(n BIGINT) RETURNS STRING": "lower(hex(n))",
    "starts_with(t STRING, part STRING) RETURNS BOOLEAN": "startswith(t, part)",
    "truncate_number(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x < 0 THEN -floor(-x) ELSE floor(x) END",
    "ns_to_timestamp(n BIGINT) RETURNS TIMESTAMP": "timestamp_micros((n - pmod(n, 1000)) div 1000)",
    "to_timestamp_millis(n BIGINT) RETURNS BIGINT": "n * 1000000",
    "to_timestamp_micros(n BIGINT) RETURNS BIGINT": "n * 1000",
    "to_timestamp_seconds(n BIGINT) RETURNS BIGINT": "n * 1000000000",
    "now_ns() RETURNS BIGINT": "unix_micros(current_timestamp()) * 1000",
    "regex_match(t STRING, pattern STRING) RETURNS BOOLEAN": "t RLIKE pattern",
    "regex_not_match(t STRING, pattern STRING) RETURNS BOOLEAN": "NOT (t RLIKE pattern)",
    "window_bounds(t BIGINT, every BIGINT, off BIGINT) RETURNS BIGINT": "t - pmod(t - off, every) + every",
}

# Aggregates cannot be SQL functions of one's own; calls of selectors are written out before the text is parsed.
SELECTORS = {
    "first": ("min_by({v}, {t})", "min({t})"), "last": ("max_by({v}, {t})", "max({t})"),
    "min": ("min(CASE WHEN {v} IS NOT NULL THEN struct({v} AS v, {t} AS t) END).v", "min(CASE WHEN {v} IS NOT NULL THEN struct({v} AS v, {t} AS t) END).t"),
    "max": ("max(CASE WHEN {v} IS NOT NULL THEN struct({v} AS v, -{t} AS t) END).v", "-max(CASE WHEN {v} IS NOT NULL THEN struct({v} AS v, -{t} AS t) END).t"),
}
_CALL = re.compile(r"\bselector_(first|last|min|max)_(value|time)\s*\(([^(),]+),([^(),]+)\)", re.IGNORECASE)


def write_out(text: str) -> str:
    """``text`` with calls of selectors replaced; their arguments are columns or simple expressions."""
    put = lambda m: "(" + SELECTORS[m[1].lower()][m[2].lower() == "time"].format(v=f"({m[3].strip()})", t=f"({m[4].strip()})") + ")"
    return outside_quotes(text, lambda part: _CALL.sub(put, part))


def outside_quotes(text: str, change: Callable[[str], str]) -> str:
    """``change`` applied to the parts of a statement that are neither string, quoted name nor comment."""
    parts = re.split(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*)""", text)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; to repeat it changes nothing."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
