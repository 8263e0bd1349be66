"""Irregular readings onto a regular grid.

A request names a table, a half-open range, a window width and an offset. Readings meet their requests in an equi-join
on table and time bucket with the range as a residual; a point written several times counts once, with its last
non-null value. Where readings must be shuffled for that, points are made where the shuffle brought them, before
requests multiply them, and buckets that hold many readings are spread by the source and time of the point. Per source the sorted grid is then merged as-of with the readings: every window knows the nearest
reading before and after it, from which an empty window is filled by time-weighted linear interpolation at its stop,
provided the two readings are no further apart than the gap limit, and is marked as a gap otherwise.

The merge is a scan in two levels. The grid of a source is cut into blocks of ``BLOCK`` windows; neighbours are carried
inside blocks, and between blocks only over one row per block, so one endless request is not one endless task.

Defined cases: a null offset is 0; a request with ``range_end <= range_start``, a null bound or no positive width has
no windows; a source whose readings are all null has all its windows empty; repeated requests are answered under their
own ids; readings without time, table or host name no source. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import int_div, window_start
from tidemark.session import cut_lineage

#: Width in ns of the time buckets in which readings meet requests.
BUCKET = 3_600_000_000_000
#: Windows in one block of a source's grid.
BLOCK = 4096
#: A table and bucket with more readings than this is spread over several tasks, each of about so many ...
HOT_ROWS = 1_000_000
#: ... or, beyond this many times as many readings, of so small a share of them all: the hot ones are no more than that.
MOST_HOT = 10_000
#: Requests with no more bucket rows than this (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def _requests(requests: DataFrame) -> DataFrame:
    c = F.col
    return requests.select(
        c("request_id").cast("bigint").alias("request_id"), "db_name", "table_name", "range_start", "range_end", "window_every",
        F.coalesce(c("window_offset"), F.lit(0)).alias("window_offset"), "aggregate",
    ).filter((c("range_end") > c("range_start")) & (c("window_every") > 0))


def window_values(readings: DataFrame, requests: DataFrame, source: str = "host") -> DataFrame:
    """Per request, source and window that has any reading: count, sum, min, max and the first and last (time, value)."""
    c = F.col
    asked = _requests(requests)
    floor = lambda t: int_div(t - F.pmod(t, F.lit(BUCKET)), BUCKET)
    buckets = F.sequence(floor(c("range_start")), floor(c("range_end") - 1))
    left = asked.select("*", F.explode(buckets).alias("bucket"))
    rows = readings.select("db_name", "table_name", c(source).alias("source"), "time", c("value").cast("double").alias("value"), "seq").filter(c("source").isNotNull() & c("time").isNotNull())
    rows = rows.withColumn("bucket", floor(c("time")))
    place, point = ["db_name", "table_name", "bucket"], ["source", "time"]
    # A point written again counts once, with its last non-null value.
    last = F.max_by("value", F.when(c("value").isNotNull(), c("seq"))).alias("value")
    inside = (c("time") >= c("range_start")) & (c("time") < c("range_end"))
    # Spark estimates an exploded side by its size before; its true size decides here whether readings are shuffled.
    wide = asked.agg(F.sum(floor(c("range_end") - 1) - floor(c("range_start")) + 1)).first()[0] or 0
    if wide <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(left), place).filter(inside)
        kept = [*place, *point, "request_id", "window_every", "window_offset"]
        met = met.groupBy(*kept).agg(last)
    else:
        most = max(HOT_ROWS, rows.count() // MOST_HOT)
        hot = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).alias("salts")).filter("salts > 1")
        spread = lambda df: df.join(F.broadcast(hot), place, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        salted = spread(rows).withColumn("salt", F.pmod(F.xxhash64(*point), c("salts"))).drop("salts")
        points = salted.repartition(*place, "salt").groupBy(*place, "salt", *point).agg(last)
        left = spread(left).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), c("salts") - 1)))
        met = points.join(left.hint("merge"), [*place, "salt"]).filter(inside)
    at = window_start(c("time"), c("window_every"), c("window_offset"))
    has = c("value").isNotNull()
    return met.groupBy("request_id", "source", at.alias("w")).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(F.when(has, c("time"))).alias("first_time"), F.min_by("value", F.when(has, c("time"))).alias("first_value"),
        F.max(F.when(has, c("time"))).alias("last_time"), F.max_by("value", F.when(has, c("time"))).alias("last_value"),
    )


def regular_grid(readings: DataFrame, requests: DataFrame, source: str = "host", gap_windows: int = 4) -> DataFrame:
    """One row per request, source and window: ``window_stop``, ``value``, ``state`` (observed, interpolated, gap).

    ``value`` is the request's aggregate where the window has a value. Where it has none, a count is 0, a sum is null,
    and the others are interpolated at the window's stop between neighbours at most ``gap_windows`` widths apart.
    """
    c = F.col
    asked = _requests(requests)
    values = cut_lineage(window_values(readings, requests, source))
    first = window_start(c("range_start"), c("window_every"), c("window_offset"))
    count = F.expr("(range_end - 1 - w0) div window_every + 1")
    asked = asked.withColumn("w0", first).withColumn("windows", count)
    sources = values.select("request_id", "source").distinct()
    blocks = sources.join(asked, "request_id").withColumn("block", F.explode(F.expr(f"sequence(0L, (windows - 1) div {BLOCK})")))

    # Between blocks: the last reading of the blocks before and the first of the blocks after.
    placed = values.join(asked.select("request_id", "w0", "window_every"), "request_id").withColumn("block", F.expr(f"(w - w0) div window_every div {BLOCK}"))
    ends = placed.filter(c("n") > 0).groupBy("request_id", "source", "block").agg(
        F.max("last_time").alias("bl_time"), F.max_by("last_value", "last_time").alias("bl_value"), F.min("first_time").alias("bf_time"), F.min_by("first_value", "first_time").alias("bf_value")
    )
    of = Window.partitionBy("request_id", "source")
    back, ahead = of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), of.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    held = lambda name, w: F.last(name, ignorenulls=True).over(w)
    blocks = blocks.join(ends.hint("merge"), ["request_id", "source", "block"], "left").select(
        *blocks.columns, held("bl_time", back).alias("before_time"), held("bl_value", back).alias("before_value"), held("bf_time", ahead).alias("after_time"), held("bf_value", ahead).alias("after_value")
    )

    # Inside blocks: the sorted grid, carried forwards and backwards.
    steps = F.expr(f"sequence(block * {BLOCK}, least(windows, (block + 1) * {BLOCK}) - 1)")
    grid = blocks.withColumn("step", F.explode(steps)).withColumn("w", c("w0") + c("step") * c("window_every"))
    grid = grid.join(values.hint("merge"), ["request_id", "source", "w"], "left")
    inside = Window.partitionBy("request_id", "source", "block")
    back, ahead = inside.orderBy("w").rowsBetween(Window.unboundedPreceding, -1), inside.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda name, w, other: F.coalesce(held(name, w), c(other))
    grid = grid.select(
        "request_id", "source", "w", "window_every", "aggregate", "n", "total", "low", "high", "first_value", "last_value",
        near("last_time", back, "before_time").alias("t0"), near("last_value", back, "before_value").alias("v0"),
        near("first_time", ahead, "after_time").alias("t1"), near("first_value", ahead, "after_value").alias("v1"),
    )
    stop = c("w") + c("window_every")
    seen = F.coalesce(c("n"), F.lit(0)) > 0
    close = c("t0").isNotNull() & c("t1").isNotNull() & (c("t1") - c("t0") <= c("window_every") * gap_windows)
    line = c("v0") + (c("v1") - c("v0")) * ((stop - c("t0")) / (c("t1") - c("t0")))
    kinds = c("aggregate").isin("count", "sum")
    state = F.when(seen, "observed").when(close & ~kinds, "interpolated").otherwise("gap")
    return grid.select("request_id", c("source").alias(source), stop.alias("window_stop"), _value(seen, close, line).alias("value"), state.alias("state"))


def _value(seen: Column, close: Column, line: Column) -> Column:
    c, kind = F.col, F.col("aggregate")
    observed = (
        F.when(kind == "count", c("n").cast("double")).when(kind == "sum", c("total")).when(kind == "min", c("low")).when(kind == "max", c("high"))
        .when(kind == "first", c("first_value")).when(kind == "last", c("last_value")).otherwise(c("total") / c("n"))
    )
    return F.when(seen, observed).when(kind == "count", 0.0).when(close & (kind != "sum"), line)


def empty_windows(grid: DataFrame, source: str = "host") -> DataFrame:
    """(request_id, source, window_stop) of the windows without a value."""
    return grid.filter(F.col("state") != "observed").select("request_id", source, "window_stop")
