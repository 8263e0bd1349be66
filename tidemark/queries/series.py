"""Queries of the time-series engine's own operators over the driver's tables, with their SQL.

``events`` is a series table: tags ``event_type`` and ``user_id`` (as text), field ``value``, ``time`` in nanoseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import partitioning, windows
from tidemark.functions.sqlnames import register
from tidemark.operators import dedup, pivot, reorg
from tidemark.plans import predicate as P
from tidemark.plans import requests as R
from tidemark.plans import series as S
from tidemark.plans.predicate import Compare, Literal, Logical, Predicate, Ref
from tidemark.plans.schema import TsTable, sort_key, union_tables
from tidemark.session import table
from tidemark.sources import system_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000_000

#: The series table in SQL.
E = "WITH e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, value, epoch_us(ts) * 1000 AS time, event_id AS seq FROM events) "


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> TsTable:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = table(spark, d, "events").select(
        "event_type", F.col("user_id").cast("string").alias("user_id"), "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time"), F.col("event_id").alias("_seq"),
    )
    return TsTable.of(df, ["event_type", "user_id"], "events")


def by_type(spark: SparkSession, d: str) -> TsTable:
    """The same with ``event_type`` as the only tag, the hour as time and a third of the values null: many duplicates."""
    t = events(spark, d)
    value = F.when(F.col("_seq") % 3 != 0, F.col("value"))
    time = F.col("time") - F.pmod("time", F.lit(HOUR))
    return TsTable.of(t.df.select("event_type", value.alias("value"), time.alias("time"), "_seq"), ["event_type"], "events")


BY_TYPE = "WITH b AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value, epoch_us(ts) * 1000 // 3600000000000 * 3600000000000 AS time, event_id AS seq FROM events) "


def database(spark: SparkSession, d: str) -> R.Database:
    """Two tables: the events, and the orders with their status and priority as tags."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("time"), F.col("o_orderkey").alias("_seq"),
    )
    return R.Database(spark, {"events": events(spark, d), "orders": TsTable.of(orders, ["priority", "status"], "orders")})


def readings(spark: SparkSession, d: str, every: bool = False) -> TsTable:
    """The readings of the first measurement by name (or of all) as one series table, with a tag that is always null."""
    df = table(spark, d, "readings")
    if not every:
        df = df.filter(F.col("table_name") == df.select(F.min("table_name")).first()[0])
    return TsTable.of(df.select("host", "region", "value", "time", F.lit(None).cast("string").alias("never"), F.col("seq").alias("_seq")), ["host", "region", "never"], "r")


ORDERS = "o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, epoch_us(o_orderdate) * 1000 AS time FROM orders) "
MARK = "(SELECT min(time) + (max(time) - min(time)) // 2 FROM e)"


def middle(t: TsTable) -> int:
    """The middle of the table's time, which splits it in two."""
    low, high = t.df.agg(F.min("time"), F.max("time")).first()
    return low + (high - low) // 2


# Scans


@query(E + "SELECT event_type, user_id, value, time FROM e")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).shown()


@query("SELECT event_type, value FROM events")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", "value")


@query(E + "SELECT user_id, value FROM e WHERE event_type = 'click' AND value > 50")
def read_filter_cols(spark: SparkSession, d: str) -> DataFrame:
    p = Predicate().where(Compare("=", Ref("event_type"), Literal("click")), Compare(">", Ref("value"), Literal(50)))
    return R.read_columns(events(spark, d), ["user_id", "value"], p)


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, value, epoch_us(ts) * 1000 AS time FROM events")
def lineproto_parse(spark: SparkSession, d: str) -> DataFrame:
    """Events written out as line protocol and parsed back by the source."""
    from tidemark.operators import quarantine

    t = events(spark, d).df
    line = F.concat(F.lit("events,event_type="), "event_type", F.lit(",user_id="), "user_id", F.lit(" value="), F.format_string("%.17f", "value"), F.lit(" "), F.col("time").cast("string"))
    valid, _ = quarantine.split_valid(quarantine.parse_lines(t.select(line.alias("lp")), "lp"))
    points = quarantine.typed_rows(valid)
    return points.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), F.col("f64")["value"].alias("value"), "time")


# Predicates


@query(E + f"SELECT event_type, user_id, value, time FROM e WHERE time >= {MARK} AND time < {MARK} + 24 * 3600000000000")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    start = middle(t)
    return R.read_filter(t, Predicate().range(start, start + 24 * HOUR))


@query(E + "SELECT event_type, user_id, value, time FROM e WHERE event_type = 'view' AND value < 20.0 AND user_id <> '7'")
def filter_conj(spark: SparkSession, d: str) -> DataFrame:
    p = Predicate().where(Compare("=", Ref("event_type"), Literal("view")), Compare("<", Ref("value"), Literal(20.0)), Compare("!=", Ref("user_id"), Literal("7")))
    return R.read_filter(events(spark, d), p)


@query(E + "SELECT event_type, user_id, time FROM e")
def field_restrict(spark: SparkSession, d: str) -> DataFrame:
    return R.read_filter(events(spark, d), Predicate().field_columns("no such field"))


@query(E + "SELECT event_type, user_id, value, time FROM e WHERE (value * 2 + 1 >= 100 OR value <= 3.5) AND NOT (event_type = 'view')")
def pred_compare(spark: SparkSession, d: str) -> DataFrame:
    double = P.Arithmetic("+", P.Arithmetic("*", Ref("value"), Literal(2)), Literal(1))
    either = Logical("or", (Compare(">=", double, Literal(100)), Compare("<=", Ref("value"), Literal(3.5))))
    return R.read_filter(events(spark, d), Predicate().where(either, Compare("!=", Ref("event_type"), Literal("view"))))


@query("SELECT 'orders' AS measurement WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 0)")
def pred_missing_col(spark: SparkSession, d: str) -> DataFrame:
    """A table without a column of the predicate is skipped, even under OR."""
    either = Logical("or", (Compare("=", Ref("status"), Literal("O")), Compare(">", Ref("price"), Literal(0.0))))
    return database(spark, d).measurement_names(Predicate().where(either))


@query(E + "SELECT event_type, user_id, value, time FROM e WHERE regexp_matches(event_type, 'l.*k')")
def regex_match(spark: SparkSession, d: str) -> DataFrame:
    return R.read_filter(events(spark, d), Predicate().where(Compare("=~", Ref("event_type"), Literal("l.*k"))))


@query(E + "SELECT event_type, user_id, value, time FROM e WHERE NOT regexp_matches(user_id, '^1[0-9]$')")
def regex_not_match(spark: SparkSession, d: str) -> DataFrame:
    return R.read_filter(events(spark, d), Predicate().where(Compare("!~", Ref("user_id"), Literal("^1[0-9]$"))))


@query("SELECT 'events' AS tag_value WHERE EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'orders' WHERE EXISTS (SELECT 1 FROM orders)")
def rpc_in_list(spark: SparkSession, d: str) -> DataFrame:
    """An OR of equalities on the measurement becomes a set of tables."""
    leaf = lambda name: {"type": "compare", "op": "equal", "children": [{"type": "tag", "name": "\x00"}, {"type": "literal", "value": name}]}
    tree = {"type": "paren", "children": [{"type": "logical", "op": "or", "children": [leaf("events"), leaf("orders")]}]}
    return database(spark, d).tag_values("_measurement", P.from_tree(tree))


@query(E + "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM e WHERE value > 99 LIMIT 1)")
def exists_pred(spark: SparkSession, d: str) -> DataFrame:
    return R.satisfies(events(spark, d), Predicate().where(Compare(">", Ref("value"), Literal(99))))


# Upserts


@query(BY_TYPE + "SELECT event_type, time, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM b GROUP BY ALL")
def dedup_last_non_null(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_last_non_null(by_type(spark, d)).df.select("event_type", "time", "value")


@query(BY_TYPE + "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT event_type, time FROM b)) AS keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, time FROM b)) AS removed FROM b")
def dedup_count(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_count(by_type(spark, d))


# Metadata requests


@query("SELECT 'events' AS measurement WHERE EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'orders' WHERE EXISTS (SELECT 1 FROM orders)")
def measurement_names(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).measurement_names()


@query("""SELECT tag_key FROM (
  SELECT 'host' AS tag_key, count(host) AS n FROM r UNION ALL SELECT 'region', count(region) FROM r UNION ALL SELECT 'never', 0
) WHERE n > 0""".replace("FROM r", "FROM (SELECT * FROM readings WHERE table_name = (SELECT min(table_name) FROM readings) AND value > 0)"))
def tag_keys(spark: SparkSession, d: str) -> DataFrame:
    """Tags with a value among the rows that match; one tag of the table never has one."""
    t = readings(spark, d)
    return R.Database(spark, {"r": t}).tag_keys(Predicate().where(Compare(">", Ref("value"), Literal(0))))


@query("""SELECT '_field' AS tag_key UNION ALL SELECT '_measurement' UNION ALL
  SELECT tag_key FROM (SELECT 'host' AS tag_key, count(host) AS n FROM readings UNION ALL SELECT 'region', count(region) FROM readings) WHERE n > 0""")
def tag_keys_request(spark: SparkSession, d: str) -> DataFrame:
    """The request for tag keys also lists the pseudo tags of the measurement and the field."""
    keys = R.Database(spark, {"r": readings(spark, d, every=True)}).tag_keys(pseudo=True)
    names = F.when(F.col("tag_key") == P.MEASUREMENT_REF[1], P.MEASUREMENT_REF[0]).when(F.col("tag_key") == P.FIELD_REF[1], P.FIELD_REF[0]).otherwise(F.col("tag_key"))
    return keys.select(names.alias("tag_key"))


@query("SELECT DISTINCT o_orderstatus AS tag_value FROM orders WHERE o_totalprice > 100000")
def measurement_tag_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a tag in one measurement."""
    return database(spark, d).tag_values("status", Predicate().table("orders").where(Compare(">", Ref("price"), Literal(100000.0))))


@query("SELECT 'priority' AS tag_key WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority IS NOT NULL) UNION ALL SELECT 'status' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus IS NOT NULL)")
def measurement_tag_keys(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).tag_keys(Predicate().table("orders"))


@query("SELECT 'price' AS name, 'float' AS type, epoch_us(max(o_orderdate)) * 1000 AS last_timestamp FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus = 'F'")
def measurement_fields(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).field_columns(Predicate().table("orders").where(Compare("=", Ref("status"), Literal("F"))))


@query("SELECT unnest(['Group', 'Group', 'Group', 'Group', 'WindowAggregate', 'WindowAggregate', 'WindowAggregate', 'WindowAggregate', 'WindowAggregate']) AS feature, unnest(['First', 'Last', 'Min', 'Max', 'Count', 'Sum', 'Min', 'Max', 'Mean']) AS aggregate")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f, a) for f, names in R.Database.capabilities().items() for a in names], "feature string, aggregate string")


@query(E + "SELECT DISTINCT user_id AS tag_value FROM e WHERE value > 90")
def tag_values(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).tag_values("user_id", Predicate().where(Compare(">", Ref("value"), Literal(90))))


@query("SELECT 'price' AS tag_value WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice IS NOT NULL) UNION ALL SELECT 'value' WHERE EXISTS (SELECT 1 FROM events WHERE value IS NOT NULL)")
def tag_values_field(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).tag_values("_field")


@query(E + ", " + ORDERS + "SELECT 'value' AS name, 'float' AS type, max(time) AS last_timestamp FROM e WHERE value IS NOT NULL UNION ALL SELECT 'price', 'float', max(time) FROM o WHERE price IS NOT NULL")
def field_columns(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).field_columns()


@query(E + ", " + ORDERS + "SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM e)) + (SELECT count(*) FROM (SELECT DISTINCT status, priority FROM o)) AS BIGINT) AS series")
def series_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).series_cardinality()


# Reads


@query(E + "SELECT event_type, user_id, value, time FROM e WHERE event_type IN ('click', 'purchase')")
def read_filter(spark: SparkSession, d: str) -> DataFrame:
    either = Logical("or", tuple(Compare("=", Ref("event_type"), Literal(v)) for v in ("click", "purchase")))
    return R.read_filter(events(spark, d), Predicate().where(either))


def _group(kind: str | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = R.read_group(events(spark, d), Predicate(), kind, ["user_id"])
        return df.withColumn("value", F.round("value", {"sum": 4, "mean": 8}[kind])) if kind in ("sum", "mean") else df

    return run


for _kind, _agg in (("sum", "round(sum(value), 4)"), ("count", "count(value)"), ("mean", "round(avg(value), 8)")):
    query(E + f"SELECT user_id, event_type, {_agg} AS value, max(time) AS time FROM e GROUP BY ALL", f"read_group_{_kind}")(_group(_kind))
for _kind, _order in (("first", "time"), ("last", "time DESC"), ("min", "value, time"), ("max", "value DESC, time")):
    query(
        E + f"SELECT user_id, event_type, value, time AS time_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_order}) AS k FROM e) WHERE k = 1",
        f"read_group_{_kind}",
    )(_group(_kind))
query(E + "SELECT user_id, event_type, value, time FROM e", "read_group_none")(_group(None))


def _window(kind: str, every: windows.Span, offset: windows.Span) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = events(spark, d)
        df = R.read_window_aggregate(t, Predicate(), kind, every, offset)
        return df.withColumn("value", F.round("value", {"sum": 4, "mean": 8}[kind])) if kind in ("sum", "mean") else df

    return run


_OFFSET = 600_000_000_000
for _kind, _agg in (("mean", "round(avg(value), 8)"), ("sum", "round(sum(value), 4)"), ("count", "count(value)"), ("min", "min(value)"), ("max", "max(value)")):
    query(
        E + f"SELECT event_type, user_id, time - (((time - {_OFFSET}) % {HOUR}) + {HOUR}) % {HOUR} + {HOUR} AS time, {_agg} AS value FROM e GROUP BY ALL",
        f"window_agg_{_kind}",
    )(_window(_kind, windows.Span(ns=HOUR), windows.Span(ns=_OFFSET)))
query(
    E + "SELECT event_type, user_id, epoch_us(date_trunc('month', make_timestamp(time // 1000)) + INTERVAL 1 MONTH) * 1000 AS time, round(avg(value), 8) AS value FROM e GROUP BY ALL",
    "window_agg_months",
)(_window("mean", windows.Span(months=1), windows.Span()))


@query(E + "SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL")
def reorder_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    return t.df.groupBy(*R.reorder_prefix(["user_id"], t.schema.tags)).agg(F.count(F.lit(1)).alias("n"))


L = """WITH l AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey AS VARCHAR) AS supplier, CAST(l_partkey AS VARCHAR) AS part, CAST(l_linenumber AS VARCHAR) AS line,
  l_quantity AS quantity, l_extendedprice AS price, epoch_us(l_shipdate) * 1000 AS time FROM lineitem) """


def shipped(spark: SparkSession, d: str) -> TsTable:
    """Order lines as a series table with five tags."""
    c = F.col
    df = table(spark, d, "lineitem").select(
        c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"), c("l_suppkey").cast("string").alias("supplier"), c("l_partkey").cast("string").alias("part"),
        c("l_linenumber").cast("string").alias("line"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), (F.unix_micros(c("l_shipdate").cast("timestamp")) * 1000).alias("time"),
    )
    return TsTable.of(df, ["flag", "status", "supplier", "part", "line"], "lines")


# Aggregates


def _aggregates(tag: str, wanted: dict[str, tuple[str, str]]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = R.group_columns(shipped(spark, d), [tag], list(wanted.values()))
        return df.select(tag, *[(F.round(f"{c}_{k}", 6) if k in ("sum", "mean") else F.col(f"{c}_{k}")).alias(name) for name, (c, k) in wanted.items()])

    return run


for _name, _tag, _wanted in (
    ("agg_sum", "flag", {"total": ("quantity", "sum")}), ("agg_count", "line", {"n": ("price", "count")}),
    ("agg_minmax", "supplier", {"low": ("price", "min"), "high": ("price", "max")}), ("agg_mean", "part", {"mean": ("quantity", "mean")}),
):
    _sql = ", ".join(f"{'round(sum({}), 6)' if k == 'sum' else 'round(avg({}), 6)' if k == 'mean' else k + '({})'} AS {n}".format(c) for n, (c, k) in _wanted.items())
    query(f"{L}SELECT {_tag}, {_sql} FROM l GROUP BY {_tag}", _name)(_aggregates(_tag, _wanted))


@query(E + "SELECT event_type, user_id, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, arg_min(value, time) AS first, arg_max(value, time) AS last FROM e GROUP BY ALL")
def rb_group_agg(spark: SparkSession, d: str) -> DataFrame:
    wanted = [("value", kind) for kind in ("count", "sum", "min", "max", "first", "last")]
    df = R.group_columns(events(spark, d), ["event_type", "user_id"], wanted)
    names = {"value_count": "n", "value_sum": "total", "value_min": "low", "value_max": "high", "value_first": "first", "value_last": "last"}
    return df.withColumnsRenamed(names).withColumn("total", F.round("total", 4))


# The shapes of the known benchmarks: groups of few and many values, and a projection with and without a condition.


def _grouped(tag: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = R.group_columns(shipped(spark, d), [tag], [("price", "sum"), ("price", "count")])
        return df.withColumn("price_sum", F.round("price_sum", 2))

    return run


for _tag, _size in (("flag", "few"), ("supplier", "more"), ("part", "many")):
    query(L + f"SELECT {_tag}, round(sum(price), 2) AS price_sum, count(price) AS price_count FROM l GROUP BY {_tag}", f"group_{_size}")(_grouped(_tag))


@query(L + "SELECT flag, status, supplier, part, line, round(sum(quantity), 2) AS quantity, max(time) AS time FROM l WHERE supplier = '7' GROUP BY ALL")
def group_tags_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Sums of all tag sets of one supplier, in the order of one tag."""
    p = Predicate().where(Compare("=", Ref("supplier"), Literal("7"))).field_columns("quantity")
    return R.read_group(shipped(spark, d), p, "sum", ["status"]).withColumn("quantity", F.round("quantity", 2))


@query(L + "SELECT supplier, part, price FROM l")
def project_plain(spark: SparkSession, d: str) -> DataFrame:
    return R.read_columns(shipped(spark, d), ["supplier", "part", "price"], Predicate())


@query(L + "SELECT supplier, part, price FROM l WHERE flag = 'R' AND quantity > 25")
def project_filtered(spark: SparkSession, d: str) -> DataFrame:
    p = Predicate().where(Compare("=", Ref("flag"), Literal("R")), Compare(">", Ref("quantity"), Literal(25.0)))
    return R.read_columns(shipped(spark, d), ["supplier", "part", "price"], p)


# Pivot, split, sets


@query("""SELECT name AS non_null_column FROM (SELECT 'event_type' AS name, count(event_type) AS n FROM events UNION ALL SELECT 'time', count(ts) FROM events
  UNION ALL SELECT 'user_id', count(user_id) FROM events UNION ALL SELECT 'value', count(value) FROM events) WHERE n > 0""")
def schema_pivot(spark: SparkSession, d: str) -> DataFrame:
    shown = events(spark, d).shown().withColumn("never", F.lit(None).cast("string"))
    return pivot.schema_pivot(shown)


def _split(side: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = by_type(spark, d)
        return pivot.stream_split(t.df, F.col("value") <= 50)[side].select("event_type", "value", "time")

    return run


query(BY_TYPE + "SELECT event_type, value, time FROM b WHERE value <= 50", "split_le")(_split(0))
query(BY_TYPE + "SELECT event_type, value, time FROM b WHERE value > 50 OR value IS NULL", "split_gt")(_split(1))


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_name", "s_nationkey"))


@query("SELECT o_orderpriority, o_orderdate, o_orderkey FROM orders")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey").orderBy(F.asc_nulls_last("o_orderpriority"), F.desc("o_orderdate"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT CAST(row_number() OVER (ORDER BY n, name) - 1 AS INTEGER) AS position, name AS column_name FROM (
  SELECT 'event_type' AS name, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events UNION ALL SELECT 'time', 9223372036854775807)""")
def sort_key_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sort_key(events(spark, d)))), "position int, column_name string")


QUERIES["sort_key"], SQL["sort_key"] = QUERIES.pop("sort_key_columns"), SQL.pop("sort_key_columns")


# Series


@query(E + """SELECT event_type, user_id, value, time, '{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' AS series,
  row_number() OVER w - 1 AS series_row, row_number() OVER w = 1 AS series_start FROM e WINDOW w AS (PARTITION BY event_type, user_id ORDER BY time)""")
def series_split(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its series and its place in it."""
    t = events(spark, d)
    return S.series_split(t.df, t).drop("_seq")


@query(E + "SELECT event_type AS partition_key_vals, count(DISTINCT user_id) AS series FROM e GROUP BY event_type")
def group_start(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    return S.group_starts(t.df, t, ["event_type"]).withColumn("partition_key_vals", F.array_join("partition_key_vals", "|"))


@query(E + """SELECT user_id AS partition_key_vals, 'user_id|event_type' AS tag_keys, '{"user_id":"' || user_id || '","event_type":"' || event_type || '"}' AS tags,
  row_number() OVER (PARTITION BY user_id ORDER BY event_type) = 1 AS group_start FROM (SELECT DISTINCT event_type, user_id FROM e)""")
def group_frames(spark: SparkSession, d: str) -> DataFrame:
    """Series in groups of one user, the first of each group marked."""
    t = events(spark, d)
    return S.group_frames(t.df, t, ["user_id"]).withColumns({c: F.array_join(c, "|") for c in ("partition_key_vals", "tag_keys")})


@query(E + """, p AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY time) - 1 AS k FROM e WHERE value IS NOT NULL)
SELECT 'events' AS measurement, 'value' AS field, 'float' AS type, '{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' AS tags,
  k // 10 AS frame_no, k % 10 AS place, time, value FROM p""")
def series_frames(spark: SparkSession, d: str) -> DataFrame:
    """The points of all frames, with the frame and their place in it."""
    t = events(spark, d)
    frames = S.series_frames(t.df, t, "events", frame=10)
    points = frames.select("measurement", "field", "type", "tags", "frame_no", F.posexplode(F.arrays_zip("times", "float")).alias("place", "p"))
    return points.select("measurement", "field", "type", "tags", "frame_no", F.col("place").cast("bigint").alias("place"), F.col("p.times").alias("time"), F.col("p.float").alias("value"))



# Reorganisation


def _two_chunks(t: TsTable) -> list[TsTable]:
    return [TsTable(t.df.filter(F.col("_seq") % 2 == k), t.schema) for k in (0, 1)]


@query(BY_TYPE + "SELECT event_type, time, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM b GROUP BY ALL")
def compact(spark: SparkSession, d: str) -> DataFrame:
    done, _ = reorg.compact(_two_chunks(by_type(spark, d)))
    return done.df.select("event_type", "time", "value")


@query(BY_TYPE + ", e AS (SELECT epoch_us(ts) * 1000 AS time FROM events) " + f"SELECT event_type, time, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM b WHERE time <= {MARK} GROUP BY ALL")
def split_plan(spark: SparkSession, d: str) -> DataFrame:
    persisted, _ = reorg.split_plan(_two_chunks(by_type(spark, d)), middle(events(spark, d)))
    return persisted.select("event_type", "time", "value")


@query(BY_TYPE + ", e AS (SELECT epoch_us(ts) * 1000 AS time FROM events) " + f"SELECT event_type, time, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM b WHERE time > {MARK} GROUP BY ALL")
def split_plan_rest(spark: SparkSession, d: str) -> DataFrame:
    _, rest = reorg.split_plan(_two_chunks(by_type(spark, d)), middle(events(spark, d)))
    return rest.select("event_type", "time", "value")


@query(BY_TYPE + "SELECT event_type, time, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM b GROUP BY ALL")
def overlap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks of which two overlap by their own bounds: only these are deduplicated together; the third is known to
    be free of duplicates and read plainly."""
    t = by_type(spark, d)
    half = middle(t)
    early = dedup.dedup_last_non_null(TsTable(t.df.filter(F.col("time") < half), t.schema))
    chunks = [early, *_two_chunks(TsTable(t.df.filter(F.col("time") >= half), t.schema))]
    return dedup.scan(chunks, dedup.key_bounds(chunks), [True, False, False]).df.select("event_type", "time", "value")


# Partitioning


@query("SELECT event_id, 'events-event_type_' || event_type || '-' || strftime(ts, '%Y-%m-%d %H:00:00') AS partition_key FROM events")
def partition_key(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    parts = [partitioning.TablePart(), partitioning.ColumnPart("event_type"), partitioning.TimePart("%Y-%m-%d %H:00:00")]
    return t.df.select(F.col("_seq").alias("event_id"), partitioning.partition_key(parts, "events", t.df.columns, F.col("time")).alias("partition_key"))


@query(E + """SELECT event_type, user_id, CASE WHEN regexp_matches(event_type, '^purch') THEN 0
  ELSE CAST(CAST('0x' || substr(md5(event_type || chr(1) || user_id), 1, 15) AS BIGINT) % 8 AS INTEGER) END AS shard FROM e""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d).df
    number = partitioning.shard(F.col("event_type"), [F.col("user_id")], [("^purch", 0)], 8)
    return t.select("event_type", "user_id", number.alias("shard"))


@query(E + """SELECT shard, partition_key, count(*) AS n FROM (SELECT 'events-' || strftime(make_timestamp(time // 1000), '%Y-%m-%d') AS partition_key,
  CAST(CAST('0x' || substr(md5('events' || chr(1) || user_id), 1, 15) AS BIGINT) % 4 AS INTEGER) AS shard FROM e) GROUP BY ALL""")
def route_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows by shard and partition, as a writer with several targets lays them out."""
    parts = [partitioning.TablePart(), partitioning.TimePart("%Y-%m-%d")]
    placed = partitioning.routed(events(spark, d).df, "events", parts, ["user_id"], [], 4)
    return placed.groupBy("shard", "partition_key").agg(F.count(F.lit(1)).alias("n"))


# System tables


@query("SELECT DISTINCT id, partition_key, table_name, storage, lifecycle_action, estimated_bytes, row_count, time_of_first_write, time_of_last_write, time_closed FROM chunks")
def sys_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the chunk table in the shape of the system table."""
    return table(spark, d, "chunks").select(*[n.split()[0] for n in system_tables.CHUNKS.split(", ")]).distinct()


@query(E + """SELECT event_type AS partition_key, CAST(0 AS BIGINT) AS chunk_id, 'events' AS table_name, column_name, 'ObjectStoreOnly' AS storage, row_count, min_value, max_value FROM (
  SELECT event_type, 'event_type' AS column_name, count(event_type) AS row_count, min(event_type) AS min_value, max(event_type) AS max_value FROM e GROUP BY 1
  UNION ALL SELECT event_type, 'user_id', count(user_id), min(user_id), max(user_id) FROM e GROUP BY 1
  UNION ALL SELECT event_type, 'value', count(value), printf('%.4f', min(value)), printf('%.4f', max(value)) FROM e GROUP BY 1
  UNION ALL SELECT event_type, 'time', count(time), CAST(min(time) AS VARCHAR), CAST(max(time) AS VARCHAR) FROM e GROUP BY 1)""")
def sys_chunk_columns(spark: SparkSession, d: str) -> DataFrame:
    """Statistics by chunk; numbers with a fraction are shown with four places, as texts of doubles differ by system."""
    t = events(spark, d)
    chunks = t.df.withColumn("partition_key", F.col("event_type")).withColumn("chunk_id", F.lit(0).cast("bigint"))
    stats = system_tables.chunk_columns(chunks, t, "events", "ObjectStoreOnly")
    text = lambda c: F.when(F.col("column_name") == "value", F.format_string("%.4f", F.col(c).try_cast("double"))).otherwise(F.col(c)).alias(c)
    return stats.select("partition_key", "chunk_id", "table_name", "column_name", "storage", "row_count", text("min_value"), text("max_value"))


@query("""SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_name) - 1 AS INTEGER) AS ordinal_position FROM (
  SELECT 'events' AS table_name, unnest(['event_type', 'user_id', 'value', 'time']) AS column_name UNION ALL SELECT 'orders', unnest(['status', 'priority', 'price', 'time']))""")
def information_columns(spark: SparkSession, d: str) -> DataFrame:
    shown = system_tables.information_columns(spark, {n: t.schema for n, t in database(spark, d).tables.items()})
    return shown.select("table_name", "column_name", "ordinal_position")


# SQL surface. The statements run on Spark SQL over the same views, with the reference's function names registered.


def _spark_sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        register(spark)
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in spark_text:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(spark_text)

    query(duck_text or spark_text, name)(run)


_spark_sql("sql_count_group", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
_spark_sql("sql_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
_spark_sql("sql_join_inner", """SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
_spark_sql("sql_join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
_spark_sql("sql_join_full", """SELECT c.k AS customer_nation, s.k AS supplier_nation FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) c
  FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 5) s ON c.k = s.k""")
_spark_sql("sql_join_using", """SELECT c_nationkey, n_name, count(*) AS n FROM customer JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation) x USING (c_nationkey) GROUP BY c_nationkey, n_name""")
_spark_sql("sql_semi", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
_spark_sql("sql_anti", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_spark_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8")
_spark_sql("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_spark_sql("sql_cte", """WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS best FROM totals)
  SELECT t.o_custkey, round(t.total, 2) AS total FROM totals t, top WHERE t.total > top.best * 0.8""")
_spark_sql("sql_case", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS class,
  NULLIF(o_orderstatus, 'O') AS closed, o_orderpriority LIKE '1%' AS urgent, o_totalprice BETWEEN 1000 AND 2000 AS narrow FROM orders""")
_spark_sql("sql_math", """SELECT event_id, round(abs(value - 50), 6) AS a, round(sqrt(abs(value)), 6) AS b, floor(value) AS c, ceil(value) AS d, round(ln(abs(value) + 1), 6) AS e,
  round(log10(abs(value) + 1), 6) AS f, round(log2(abs(value) + 1), 6) AS g, CAST(sign(value - 50) AS DOUBLE) AS h, round(sin(value), 6) AS i, round(cos(value), 6) AS j,
  round(tan(value / 100), 6) AS k, round(atan(value), 6) AS l, round(asin(value / 1000), 6) AS m, round(acos(value / 1000), 6) AS n, round(exp(value / 100), 6) AS o, truncate_number(value) AS p FROM events""",
  """SELECT event_id, round(abs(value - 50), 6) AS a, round(sqrt(abs(value)), 6) AS b, CAST(floor(value) AS BIGINT) AS c, CAST(ceil(value) AS BIGINT) AS d, round(ln(abs(value) + 1), 6) AS e,
  round(log10(abs(value) + 1), 6) AS f, round(log2(abs(value) + 1), 6) AS g, CAST(sign(value - 50) AS DOUBLE) AS h, round(sin(value), 6) AS i, round(cos(value), 6) AS j,
  round(tan(value / 100), 6) AS k, round(atan(value), 6) AS l, round(asin(value / 1000), 6) AS m, round(acos(value / 1000), 6) AS n, round(exp(value / 100), 6) AS o, trunc(value) AS p FROM events""")  # fmt: skip
_spark_sql("sql_string", """SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, char_length(c_name) AS c, concat(c_mktsegment, '-', c_name) AS d, lpad(c_mktsegment, 12, '*') AS e,
  rpad(c_mktsegment, 12, '*') AS f, trim('  ' || c_name || ' ') AS g, replace(c_name, '0', 'o') AS h, repeat(left(c_name, 1), 3) AS i, split_part(c_name, '#', 1) AS j,
  starts_with(c_name, 'Cust') AS k, strpos(c_name, '#') AS l, to_hex(c_custkey) AS m, reverse(c_mktsegment) AS n, substr(c_name, 2, 4) AS o, ascii(c_name) AS p, octet_length(c_name) AS q,
  translate(c_name, 'abc', 'xyz') AS r, btrim(c_name) AS s, bit_length(c_name) AS t, right(c_name, 3) AS u, concat_ws('/', c_name, c_mktsegment) AS v, initcap('a' || c_mktsegment) AS w FROM customer""",
  """SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, CAST(length(c_name) AS INTEGER) AS c, concat(c_mktsegment, '-', c_name) AS d, lpad(c_mktsegment, 12, '*') AS e,
  rpad(c_mktsegment, 12, '*') AS f, trim('  ' || c_name || ' ') AS g, replace(c_name, '0', 'o') AS h, repeat(left(c_name, 1), 3) AS i, split_part(c_name, '#', 1) AS j,
  starts_with(c_name, 'Cust') AS k, CAST(strpos(c_name, '#') AS INTEGER) AS l, lower(to_hex(c_custkey)) AS m, reverse(c_mktsegment) AS n, substr(c_name, 2, 4) AS o, ascii(c_name) AS p, CAST(strlen(c_name) AS INTEGER) AS q,
  translate(c_name, 'abc', 'xyz') AS r, trim(c_name) AS s, CAST(bit_length(c_name) AS INTEGER) AS t, right(c_name, 3) AS u, concat_ws('/', c_name, c_mktsegment) AS v, 'A' || lower(c_mktsegment) AS w FROM customer""")  # fmt: skip
_spark_sql("sql_date_trunc", """SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('month', ts) AS month, CAST(date_part('year', ts) AS BIGINT) AS year, CAST(date_part('day', ts) AS BIGINT) AS day FROM events""")
_spark_sql("sql_to_timestamp", """SELECT event_id FROM events WHERE unix_micros(CAST(ts AS TIMESTAMP)) * 1000 >= to_timestamp_ns('2024-01-02T03:04:05.123456789Z')""",
  """SELECT event_id FROM events WHERE epoch_us(ts) * 1000 >= 1704164645123456789""")  # fmt: skip
_spark_sql("sql_window_rank", """SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after,
  first_value(o_orderkey) OVER w AS first, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
_spark_sql("sql_subquery_from", "SELECT s.p AS priority, max(s.n) AS most FROM (SELECT o_orderpriority AS p, o_custkey, count(*) AS n FROM orders GROUP BY o_orderpriority, o_custkey) s GROUP BY s.p")
_spark_sql("sql_intersect_except", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
_spark_sql("sql_regex", "SELECT event_id, user_id FROM events WHERE regexp_like(event_type, 'c.*k') AND CAST(user_id AS STRING) LIKE '1%'",
  "SELECT event_id, user_id FROM events WHERE regexp_matches(event_type, 'c.*k') AND CAST(user_id AS VARCHAR) LIKE '1%'")
_spark_sql("sql_three_way", """SELECT r.r_name, count(*) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE l.l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY r.r_name""")
_spark_sql("sql_join_right", "SELECT s.s_suppkey, count(c.c_custkey) AS customers FROM customer c RIGHT JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > 5000 GROUP BY s.s_suppkey")
_spark_sql("sql_join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
_spark_sql("sql_array", "SELECT c_custkey, array_join(array(c_name, c_mktsegment), '|') AS pair FROM customer", "SELECT c_custkey, array_to_string([c_name, c_mktsegment], '|') AS pair FROM customer")
_spark_sql("sql_strings_trimmed", "SELECT c_custkey, ltrim('  ' || c_name) AS a, rtrim(c_name || '  ') AS b, chr(65 + c_nationkey) AS c, char_length(ltrim('  ' || c_mktsegment || ' ')) AS d FROM customer",
  "SELECT c_custkey, ltrim('  ' || c_name) AS a, rtrim(c_name || '  ') AS b, chr(65 + c_nationkey) AS c, CAST(length(ltrim('  ' || c_mktsegment || ' ')) AS INTEGER) AS d FROM customer")
_spark_sql("sql_timestamps", """SELECT event_id, to_timestamp_seconds(event_id) AS a, to_timestamp_millis(event_id) AS b, to_timestamp_micros(event_id) AS c, to_timestamp_ns('2024-01-01T02:00:00+02:00') AS d,
  to_timestamp_ns('2024-01-01T00:00:00.5-01:30') AS e, ns_to_timestamp(unix_micros(CAST(ts AS TIMESTAMP)) * 1000 + 999) = CAST(ts AS TIMESTAMP) AS f, now_ns() > 1700000000000000000 AS g FROM events""",
  """SELECT event_id, event_id * 1000000000 AS a, event_id * 1000000 AS b, event_id * 1000 AS c, 1704067200000000000 AS d, 1704072600500000000 AS e, true AS f, true AS g FROM events""")  # fmt: skip
_spark_sql("sql_window_bounds", "SELECT window_bounds(unix_micros(CAST(ts AS TIMESTAMP)) * 1000, 3600000000000, 600000000000) AS stop, count(*) AS n FROM events GROUP BY 1",
  f"SELECT t - (((t - {_OFFSET}) % {HOUR}) + {HOUR}) % {HOUR} + {HOUR} AS stop, count(*) AS n FROM (SELECT epoch_us(ts) * 1000 AS t FROM events) GROUP BY 1")
_spark_sql("sql_regex_names", "SELECT event_id, regex_match(event_type, 'l.*k') AS hit, regex_not_match(event_type, '^v') AS miss FROM events",
  "SELECT event_id, regexp_matches(event_type, 'l.*k') AS hit, NOT regexp_matches(event_type, '^v') AS miss FROM events")
