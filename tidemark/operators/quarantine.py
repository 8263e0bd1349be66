"""Loading text whose rows may not parse: every part is kept as nullable text, rules fill an error array, and rows
are split by whether that array is empty.

Everything is a built-in expression: the logical lines come from one possessive regular expression (which the JVM
runs as a loop, so a line may be of any length), the parts from further ones, and each rule is a ``when`` that adds
its reason. There is no Python in the path and no shuffle before the per-request count.

Defined cases: a null or empty text has no lines; a request without lines still counts as 0 lines; repeated requests
are judged one by one; extra columns of the input are carried under their own names unless they clash with an output
column, in which case the output column wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The character classes of the line-protocol grammar.
NAME = r"(?:[^ \t\n,\\]|\\[\s\S])"  # of a measurement or tag value
KEY = r"(?:[^ \t\n=\\]|\\[\s\S])"  # of a tag key or field key
STRING = r'"(?:[^"\\]|\\[\s\S])*+"'
NUMBER = r"-?[0-9]++(?:\.[0-9]++(?:[eE][-+][0-9]++)?+)?+|[0-9]++[eE][-+][0-9]++"
BOOL = r"true|True|TRUE|t|T|false|False|FALSE|f|F"
# The exponent forms come first, as a plain number is a prefix of them.
VALUE = rf"(?:-?[0-9]++i|[0-9]++u|[0-9]++[eE][-+][0-9]++|{NUMBER}|{STRING}|{BOOL})"
FIELD = rf"{KEY}++={VALUE}"
TAG = rf"{KEY}++={NAME}++"

#: One logical line: a comment, or a series followed by text in which ``="`` opens a string that may hold newlines.
LINE = (
    r"(?:[ \t]*+#[^\n]*+"
    r'|[ \t]*+(?:[^ \n\\]|\\[^\n])*+(?:="(?:[^"\\]|\\[\s\S])*+(?:"|\\?\z)|\\[^\n]?|[^\n\\])*+)'
    r"(?:\n|\z)"
)

# Most lines are plain: no escapes, numbers far from the limits of their types, and no tag key twice. One expression tells,
# and what it does not match may still be valid.
_NAME, _VALUE = r"[^ \t\n,=\\]++", r'(?:-?[0-9]{1,18}i|[0-9]{1,19}u|-?[0-9]{1,200}(?:\.[0-9]{1,200})?+|"[^"\\]*+"|' + BOOL + ")"
PLAIN = rf"^{_NAME}(?:,{_NAME}={_NAME})*+ ++{_NAME}={_VALUE}(?:,{_NAME}={_VALUE})*+(?: ++-?[0-9]{{1,18}})?+ *+\z"
TWICE = r"^[^ ,]*+(?:,[^, ]*)*?,([^,= ]++)=[^, ]*+(?:,[^, ]*)*?,\1="

REASONS = (
    "no measurement",
    "name ends with backslash",
    "malformed tag set",
    "repeated tag key",
    "no fields",
    "malformed field set",
    "integer out of range",
    "unsigned out of range",
    "float out of range",
    "timestamp out of range",
    "trailing content",
)


def logical_lines(text: Column) -> Column:
    """Array of logical lines, each without its ending newline; null text gives an empty array."""
    found = F.regexp_extract_all(text, F.lit(f"({LINE})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _rest(text: Column, *taken: Column) -> Column:
    start = F.lit(1)
    for t in taken:
        start = start + F.length(t)
    return F.substring(text, start, F.length(text))


def _unescape(name: Column) -> Column:
    return F.regexp_replace(name, r"\\([\\,= ])", "$1")


def parse_lines(df: DataFrame, text_col: str = "lp_data", line_col: str = "line_no", judge_only: bool = False) -> DataFrame:
    """``df`` exploded to one row per logical line with its parts as text. With ``judge_only`` the parts of lines that one
    expression shows to be valid are left empty.

    Added columns: ``line_no`` (from 1; null where there is no line), ``kind`` (blank, comment, line; null), ``body``,
    ``measurement``, ``tags_raw``, ``fields_raw``, ``time_raw`` and the arrays ``tag_keys``, ``tag_values``,
    ``field_keys``, ``field_values``, and ``errors``.
    """
    added = {line_col, "kind", "body", "measurement", "tags_raw", "fields_raw", "time_raw", "tail", "tag_keys",
             "tag_values", "field_keys", "field_values", "errors", "_line", "_pos", "_a", "_plain", "_read"}
    kept = [c for c in df.columns if c not in added and c != text_col]
    lines = df.select(*[F.col(f"`{c}`") for c in kept], F.posexplode_outer(logical_lines(F.col(f"`{text_col}`"))).alias("_pos", "_line"))
    # Extraction by regexp keeps the newline that ends a line; it is no part of it.
    lines = lines.withColumn("body", F.regexp_replace(F.regexp_replace("_line", r"\n\z", ""), r"^[ \t]++", ""))
    if judge_only:
        lines = lines.withColumn("_plain", F.col("body").rlike(PLAIN) & ~F.col("body").rlike(TWICE)).withColumn("_read", F.when(F.col("_plain"), "").otherwise(F.col("body")))
    else:
        lines = lines.withColumn("_plain", F.lit(False)).withColumn("_read", F.col("body"))
    head = rf"^({NAME}*+)"
    tags = r"^(,(?:[^ \t\n\\]|\\[\s\S])*+)"
    fields = rf"^ ++((?:={STRING}|\\[\s\S]|[^ \t\n\\])++)"
    parts = (
        lines.withColumn("measurement", _part(F.col("_read"), head))
        .withColumn("_a", _rest(F.col("_read"), F.col("measurement")))
        .withColumn("tags_raw", _part(F.col("_a"), tags))
        .withColumn("_a", _rest(F.col("_a"), F.col("tags_raw")))
        .withColumn("fields_raw", _part(F.col("_a"), fields))
        .withColumn("tail", _rest(F.col("_a"), _part(F.col("_a"), fields, 0)))
        .withColumn("time_raw", _part(F.col("tail"), r"^ ++(-?[0-9]++) *+\z"))
    )
    pick = lambda raw, pattern, group: F.regexp_extract_all(raw, F.lit(pattern), F.lit(group))
    tag_one, field_one = rf",({KEY}++)=({NAME}++)", rf"(?:^|,)({KEY}++)=({VALUE})(?=,|\z)"
    parts = (
        parts.withColumn("tag_keys", pick(F.col("tags_raw"), tag_one, 1))
        .withColumn("tag_values", pick(F.col("tags_raw"), tag_one, 2))
        .withColumn("field_keys", pick(F.col("fields_raw"), field_one, 1))
        .withColumn("field_values", pick(F.col("fields_raw"), field_one, 2))
    )
    kind = F.when(F.col("_pos").isNull(), None).when(F.col("body") == "", "blank").when(F.col("body").startswith("#"), "comment").otherwise("line")
    errors = F.when((F.col("kind") == "line") & ~F.col("_plain"), F.array_compact(F.array(*_rules()))).otherwise(F.array().cast("array<string>"))
    # The judged line is generated as one struct: a filter on the errors stays above it, and is not pushed to where every
    # part would be extracted again for each of its uses in the rules.
    judged = parts.withColumn("kind", kind).withColumn("errors", errors).withColumn(line_col, (F.col("_pos") + 1).cast("int"))
    shown = [line_col, "kind", "body", "measurement", "tags_raw", "fields_raw", "time_raw", "tail", "tag_keys", "tag_values", "field_keys", "field_values", "errors"]
    return judged.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*shown))))


def _rules() -> list[Column]:
    c = F.col
    ends = lambda x: x.endswith("\\")
    any_of = lambda name, f: F.exists(c(name), f)
    number = lambda v, n: F.substring(v, F.lit(1), F.length(v) - n)
    tag_form = rf"^(?:,(?:{TAG}(?:,{TAG})*+)?+)?+\z"
    # A lone comma may follow a single field, though not several.
    field_form = rf"^(?:{FIELD}(?=,?\z),?|{FIELD}(?:,{FIELD})++)\z"
    backslash = ends(c("measurement")) | any_of("tag_keys", ends) | any_of("tag_values", ends) | any_of("field_keys", ends)
    checks = [
        c("measurement") == "",
        backslash,
        ~c("tags_raw").rlike(tag_form),
        F.size(F.array_distinct(F.transform("tag_keys", _unescape))) < F.size("tag_keys"),
        c("fields_raw") == "",
        (c("fields_raw") != "") & ~c("fields_raw").rlike(field_form),
        any_of("field_values", lambda v: v.rlike(r"^-?[0-9]+i\z") & number(v, 1).try_cast("bigint").isNull()),
        any_of("field_values", lambda v: v.rlike(r"^[0-9]+u\z") & ~F.coalesce(number(v, 1).try_cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(38,0)"), F.lit(False))),
        any_of("field_values", lambda v: v.rlike(r"^-?[0-9]") & ~v.rlike(r"[iu]\z") & (F.abs(v.try_cast("double")) == float("inf"))),
        (c("time_raw") != "") & c("time_raw").try_cast("bigint").isNull(),
        (c("tail") != "") & (c("time_raw") == ""),
    ]
    return [F.when(check, F.lit(reason)) for check, reason in zip(checks, REASONS, strict=True)]


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that load, rejected rows); comments and blank lines are in neither."""
    lines = parsed.filter(F.col("kind") == "line")
    return lines.filter(F.size("errors") == 0), lines.filter(F.size("errors") > 0)


def typed_rows(valid: DataFrame, default_time: Column | None = None) -> DataFrame:
    """Valid lines as points: unescaped measurement and tags, one typed map for each kind of field, ``time`` in ns.

    A line without a timestamp takes ``default_time`` (null if none is given). Of a field named twice the last counts.
    """
    unescaped = lambda name: F.transform(name, _unescape)
    entries = F.arrays_zip(unescaped("field_keys").alias("k"), F.col("field_values").alias("v"))

    def of(test: str, value) -> Column:  # noqa: ANN001
        kept = F.filter(F.col("_fields"), lambda e: e["v"].rlike(test))
        return F.map_from_entries(F.reverse(F.array_distinct(F.transform(kept, lambda e: F.struct(e["k"], value(e["v"]))))))

    cut = lambda v: F.substring(v, F.lit(1), F.length(v) - 1)
    text = lambda v: F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return (
        valid.withColumn("_fields", F.transform(last, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))
        .withColumn("tags", F.map_from_arrays(unescaped("tag_keys"), unescaped("tag_values")))
        .withColumn("measurement", F.regexp_replace("measurement", r"\\([\\, ])", "$1"))
        .withColumn("i64", of(r"^-?[0-9]+i\z", lambda v: cut(v).cast("bigint")))
        .withColumn("u64", of(r"^[0-9]+u\z", lambda v: cut(v).cast("decimal(20,0)")))
        .withColumn("f64", of(r"^-?[0-9][-+.eE0-9]*\z", lambda v: v.cast("double")))
        .withColumn("str", of(r'^"', text))
        .withColumn("bool", of(r"^[tTfF]", lambda v: F.lower(F.substring(v, 1, 1)) == "t"))
        .withColumn("time", F.coalesce(F.col("time_raw").try_cast("bigint"), default_time if default_time is not None else F.lit(None).cast("bigint")))
        .drop("_fields", "body", "tags_raw", "fields_raw", "time_raw", "tail", "tag_keys", "tag_values", "field_keys", "field_values", "errors", "kind")
    )


def load_report(writes: DataFrame, key: str = "request_id", text: str = "lp_data", claimed: str = "lines_written") -> DataFrame:
    """(request, line_no, reason, valid_lines): one row for each rejected line, and one with line_no 0 for each request
    whose claimed number is not null and is not its number of valid lines."""
    # Requests are told apart by their row, as an id may repeat.
    parsed = parse_lines(writes.select(key, claimed, text, F.monotonically_increasing_id().alias("_request")), text, judge_only=True)
    valid = (F.col("kind") == "line") & (F.size("errors") == 0)
    bad = F.when(F.size("errors") > 0, F.struct("line_no", F.array_join("errors", "; ").alias("reason"), F.lit(None).cast("bigint").alias("valid_lines")))
    # A request's lines are made in one task, so this combines before the shuffle; its rejected lines are no longer than its text.
    judged = parsed.groupBy("_request", key, claimed).agg(F.count(F.when(valid, 1)).alias("_valid"), F.collect_list(bad).alias("_bad"))
    wrong = F.struct(F.lit(0).alias("line_no"), F.lit("lines_written differs").alias("reason"), F.col("_valid").alias("valid_lines"))
    cases = F.concat("_bad", F.when(F.col(claimed) != F.col("_valid"), F.array(wrong)).otherwise(F.slice("_bad", 1, 0)))
    return judged.select(key, F.explode(cases).alias("_case")).select(key, "_case.*")
