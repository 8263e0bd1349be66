"""Series out of rows: one series for each tag set (and field), groups of series, and the frames sent to clients.

A series may hold a third of all rows, so it is never one array: its points are numbered by a distributed sort and come in
frames of at most ``FRAME`` points. Values keep their type; points are only made of values that are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ranking import with_position
from tidemark.plans.requests import RequestError, reorder_prefix
from tidemark.plans.schema import TIME, TsTable

#: Points in one frame.
FRAME = 1_000
# The value columns of points, by the type of field; clients know no unsigned points.
POINTS = {"float": "double", "integer": "bigint", "string": "string", "boolean": "boolean"}


def tag_set(names: list[str]) -> Column:
    """The tag set as a map in the order of ``names``, without null tags."""
    if not names:
        return F.create_map().cast("map<string,string>")
    present = F.array_compact(F.array(*[F.when(F.col(f"`{t}`").isNotNull(), F.struct(F.lit(t).alias("k"), F.col(f"`{t}`").alias("v"))) for t in names]))
    return F.map_from_entries(present)


def points(df: DataFrame, table: TsTable, measurement: str) -> DataFrame:
    """Long form: (measurement, field, type, tags, time, float, integer, string, boolean), one row for each non-null field
    value, with the value in the column of its type. Tags are JSON."""
    fields = [f for f in table.schema.fields if f in df.columns]
    if unsigned := [f for f in fields if table.schema.columns[f] == "unsigned"]:
        raise RequestError(f"no points of unsigned fields: {unsigned}")
    value = lambda f: [(F.col(f"`{f}`") if table.schema.columns[f] == kind else F.lit(None)).cast(spark).alias(kind) for kind, spark in POINTS.items()]
    entries = [F.struct(F.lit(f).alias("field"), F.lit(table.schema.columns[f]).alias("type"), *value(f)) for f in fields]
    start = df.select(F.lit(measurement).alias("measurement"), F.to_json(tag_set(table.schema.tags)).alias("tags"), F.col(TIME), *[F.col(f"`{f}`") for f in fields if f != TIME])
    if not entries:
        empty = ", ".join(f"{k} {s}" for k, s in POINTS.items())
        return start.select("measurement", F.lit("").alias("field"), F.lit("").alias("type"), "tags", TIME, F.from_json(F.lit("{}"), empty).alias("_v")).select("measurement", "field", "type", "tags", TIME, "_v.*").limit(0)
    long = start.select("measurement", "tags", TIME, F.inline(F.array(*entries)))
    return long.filter(F.coalesce(*[F.col(f"`{k}`").cast("string") for k in POINTS]).isNotNull()).select("measurement", "field", "type", "tags", TIME, *POINTS)


def series_split(df: DataFrame, table: TsTable) -> DataFrame:
    """The rows of ``df`` with ``series`` (the tag set as JSON), ``series_row`` (the place of a row in its series by time,
    from 0) and ``series_start``. Rows without tags are one series."""
    keyed = df.withColumn("series", F.to_json(tag_set(table.schema.tags)))
    return with_position(keyed, ["series"], [F.col(TIME).asc()], "series_row").withColumn("series_start", F.col("series_row") == 0)


def series_frames(df: DataFrame, table: TsTable, measurement: str, frame: int = FRAME) -> DataFrame:
    """(measurement, field, type, tags, frame_no, times, float, integer, string, boolean): the points of each series and
    field in frames, in the order of time. The array of the field's type has the values; the others are null."""
    placed = with_position(points(df, table, measurement), ["measurement", "field", "type", "tags"], [F.col(TIME).asc()], "_at")
    keys = ["measurement", "field", "type", "tags"]
    cut = placed.withColumn("frame_no", F.expr(f"_at div {frame}"))
    held = cut.groupBy(*keys, "frame_no").agg(F.array_sort(F.collect_list(F.struct("_at", TIME, *POINTS))).alias("_p"))
    values = [F.when(F.col("type") == k, F.col(f"_p.{k}")).alias(k) for k in POINTS]
    return held.select(*keys, "frame_no", F.col(f"_p.{TIME}").alias("times"), *values)


def group_frames(df: DataFrame, table: TsTable, group: list[str]) -> DataFrame:
    """(partition_key_vals, tag_keys, tags): one row for each series, sorted into groups by the values of the group's tags,
    with ``group_start`` where the next group begins. Only series are sorted, not their rows."""
    tags = reorder_prefix(group, table.schema.tags)
    column = lambda t: F.col(f"`{t}`")
    series = df.select(*map(column, tags)).distinct()
    values = F.array(*[F.coalesce(column(t), F.lit("")) for t in group]) if group else F.array().cast("array<string>")
    marked = with_position(series.withColumn("partition_key_vals", values), ["partition_key_vals"], [column(t).asc() for t in tags], "_at")
    return marked.select("partition_key_vals", F.array(*map(F.lit, tags)).alias("tag_keys"), F.to_json(tag_set(tags)).alias("tags"), (F.col("_at") == 0).alias("group_start")).orderBy("partition_key_vals", F.desc("group_start"), "tags")


def group_starts(df: DataFrame, table: TsTable, group: list[str]) -> DataFrame:
    """The group headers: the values of the group's tags (null tags empty), in order, with the number of series."""
    return group_frames(df, table, group).groupBy("partition_key_vals").agg(F.count(F.lit(1)).alias("series")).orderBy("partition_key_vals")

