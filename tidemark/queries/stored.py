"""Queries of the engine's stored databases: writing, chunks, pruning, lifecycle, system tables, SQL and streams.

The events are written as line protocol to a database partitioned by event type (or by day, where chunks are pruned); then those with a value above 90 are written
again with twice the value and a note, so that reads meet rewritten points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.partitioning import ColumnPart, TimePart
from tidemark.functions.windows import Span
from tidemark.lifecycle.policy import maintain
from tidemark.plans import requests as R
from tidemark.plans.predicate import Compare, Literal, Predicate, Ref
from tidemark.queries.series import HOUR, events, middle
from tidemark.session import scratch_path
from tidemark.sources import line_protocol, system_tables
from tidemark.store.database import Rules
from tidemark.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The stored table in SQL.
W = """WITH w AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) * 1000 AS time, 'event_type_' || event_type AS part, strftime(ts, '%Y-%m-%d') AS day,
  arg_max(CASE WHEN value > 90 THEN value * 2 ELSE value END, event_id) AS value, max(CASE WHEN value > 90 THEN 'again' END) AS note FROM events GROUP BY ALL) """
MIDDLE = "(SELECT min(epoch_us(ts) * 1000) + (max(epoch_us(ts) * 1000) - min(epoch_us(ts) * 1000)) // 2 FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, d: str, again: bool = False) -> DataFrame:
    """The events as texts of one line each."""
    df = events(spark, d).df
    if again:
        df = df.filter("value > 90").withColumn("value", F.col("value") * 2)
    number = F.format_string("%.17f", "value")
    extra = F.lit(',note="again"') if again else F.lit("")
    return df.orderBy("_seq").select(F.concat(F.lit("events,event_type="), "event_type", F.lit(",user_id="), "user_id", F.lit(" value="), number, extra, F.lit(" "), F.col("time").cast("string")).alias("text"))


def engine(spark: SparkSession, d: str, clock: list[float] | None = None, by_day: bool = False, **rules) -> Engine:  # noqa: ANN003
    """A fresh engine with the events written twice over; ``clock`` holds the time its database takes for now."""
    made = Engine(spark)
    settings = {"now": lambda: clock[0]} if clock else {}
    made.create_database("db", Rules(partition_template=[TimePart("%Y-%m-%d") if by_day else ColumnPart("event_type")], **rules), **settings)
    made.write_lines("db", lines(spark, d))
    made.write_lines("db", lines(spark, d, again=True))
    return made


_SHARED: dict[tuple[str, str, bool], Engine] = {}


def shared(spark: SparkSession, d: str, by_day: bool = False) -> Engine:
    """The engine of this application for queries that only read."""
    key = (spark.sparkContext.applicationId, d, by_day)
    if key not in _SHARED:
        _SHARED[key] = engine(spark, d, by_day=by_day, open_row_threshold=1 << 60)
    return _SHARED[key]


@query(W + "SELECT event_type, user_id, time, value, note FROM w")
def write_read(spark: SparkSession, d: str) -> DataFrame:
    """What was written, from open chunks, with rewritten points merged."""
    return shared(spark, d).databases["db"].table("events").shown()


@query(W + f"SELECT event_type, user_id, time, value, note FROM w WHERE time <= {MIDDLE}")
def persist_read(spark: SparkSession, d: str) -> DataFrame:
    """Every partition is persisted up to the middle of the time; another engine finds just that by the log."""
    made, half = engine(spark, d), middle(events(spark, d))
    db = made.databases["db"]
    for table, part in db.partitions():
        db.rollover(table, part)
        db.persist([c for c in db.chunks if c.address == (table, part)], half)
    found = Engine(spark, made.root)
    found.restore()
    return found.databases["db"].table("events").shown()


@query(W + "SELECT event_type, user_id, time, value, note FROM w")
def persist_rest(spark: SparkSession, d: str) -> DataFrame:
    """After persisting a half, reads of the same engine still give the whole: persisted and remaining chunks."""
    made, half = engine(spark, d), middle(events(spark, d))
    db = made.databases["db"]
    for table, part in db.partitions():
        db.rollover(table, part)
        db.persist([c for c in db.chunks if c.address == (table, part)], half)
    return db.table("events").shown()


@query(W + f"SELECT event_type, user_id, time, value, note FROM w WHERE time >= {MIDDLE} AND time < {MIDDLE} + 24 * {HOUR} AND value > 100")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """A day's rows: chunks outside it are left out by their bounds, and the field is only looked at after merging."""
    half = middle(events(spark, d))
    p = Predicate().range(half, half + 24 * HOUR).where(Compare(">", Ref("value"), Literal(100)))
    return R.read_filter(shared(spark, d, True).databases["db"].table("events", p), p)


@query(W + f""", c AS (SELECT day, min(time) AS low, max(time) AS high FROM w GROUP BY day)
SELECT count(*) AS chunks, count(*) FILTER (WHERE high >= {MIDDLE} AND low < {MIDDLE} + 24 * {HOUR}) AS candidates FROM c""")
def pruned_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks there are, and how many a request for a day may find rows in."""
    half, db = middle(events(spark, d)), shared(spark, d, True).databases["db"]
    return spark.createDataFrame([(len(db.chunks), len(db.candidates("events", Predicate().range(half, half + 24 * HOUR))))], "chunks bigint, candidates bigint")


@query(W + "SELECT event_type, user_id, time - time % 86400000000000 + 86400000000000 AS time, count(note) AS note, count(value) AS value FROM w WHERE event_type = 'click' GROUP BY ALL")
def stored_window_count(spark: SparkSession, d: str) -> DataFrame:
    """A window request over stored chunks."""
    p = Predicate().where(Compare("=", Ref("event_type"), Literal("click")))
    return R.read_window_aggregate(shared(spark, d).databases["db"].table("events", p), p, "count", Span(ns=24 * HOUR))


@query(W + "SELECT part AS partition_key, 'ReadBuffer' AS storage, count(*) AS row_count FROM w GROUP BY ALL")
def compact_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Maintenance merges the closed chunks of every partition into one without duplicates."""
    made = engine(spark, d, [0.0], open_linger=0)
    made.maintain()
    return made.system("db", "chunks").select("partition_key", "storage", "row_count")


@query(W + "SELECT 'Complete' AS status, 'Compacting' AS description, part AS partition_key, CAST(0 AS BIGINT) AS chunk_id FROM w GROUP BY ALL")
def sys_operations(spark: SparkSession, d: str) -> DataFrame:
    made = engine(spark, d, [0.0], open_linger=0, open_row_threshold=1 << 60)
    made.maintain()
    return made.sql("db", "SELECT status, description, partition_key, chunk_id FROM system.operations")


@query(W + "SELECT part AS partition_key, 'ObjectStoreOnly' AS storage, count(*) AS row_count FROM w GROUP BY ALL")
def persist_by_age(spark: SparkSession, d: str) -> DataFrame:
    """Half an hour after the writes maintenance persists every partition."""
    clock = [1_000.0]
    made = engine(spark, d, clock)
    clock[0] += 1_800
    maintain(made.databases["db"])
    return made.system("db", "chunks").select("partition_key", "storage", "row_count")


@query(W + """SELECT part AS partition_key, 'events' AS table_name, c.name AS column_name, c.kind AS column_type, c.role FROM (SELECT DISTINCT part FROM w WHERE note IS NOT NULL), (VALUES
  ('event_type', 'String', 'tag'), ('note', 'String', 'field'), ('time', 'Time', 'time'), ('user_id', 'String', 'tag'), ('value', 'F64', 'field')) AS c(name, kind, role)
UNION ALL SELECT part, 'events', c.name, c.kind, c.role FROM (SELECT part FROM w GROUP BY part HAVING count(note) = 0), (VALUES
  ('event_type', 'String', 'tag'), ('time', 'Time', 'time'), ('user_id', 'String', 'tag'), ('value', 'F64', 'field')) AS c(name, kind, role)""")
def sys_columns(spark: SparkSession, d: str) -> DataFrame:
    shown = shared(spark, d).sql("db", "SELECT * FROM system.columns")
    return shown.withColumn("role", F.lower(F.replace("role", F.lit("Timestamp"), F.lit("time"))))


@query(W + """SELECT 'db' AS database_name, part AS partition_key, 'events' AS table_name, column_name, row_count, least, largest FROM (
  SELECT part, 'user_id' AS column_name, count(user_id) AS row_count, min(user_id) AS least, max(user_id) AS largest FROM w GROUP BY 1
  UNION ALL SELECT part, 'time', count(time), CAST(min(time) AS VARCHAR), CAST(max(time) AS VARCHAR) FROM w GROUP BY 1)""")
def observer(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the chunks of all databases, without reading the chunks."""
    made = engine(spark, d, [0.0], open_linger=0)
    made.maintain()
    stats = made.observe("chunk_columns").filter(F.col("column_name").isin("user_id", "time"))
    return stats.select("database_name", "partition_key", "table_name", "column_name", "row_count", F.col("min_value").alias("least"), F.col("max_value").alias("largest"))


@query("""SELECT 'public' AS table_catalog, * FROM (VALUES ('default', 'events', 'BASE TABLE'), ('system', 'chunks', 'BASE TABLE'), ('system', 'columns', 'BASE TABLE'), ('system', 'chunk_columns', 'BASE TABLE'),
  ('system', 'operations', 'BASE TABLE'), ('information_schema', 'tables', 'VIEW'), ('information_schema', 'columns', 'VIEW')) AS t(table_schema, table_name, table_type)""")
def show_tables(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d).sql("db", "SHOW TABLES")


@query("""SELECT 'public' AS table_catalog, 'default' AS table_schema, 'events' AS table_name, * FROM (VALUES ('event_type', 'YES', 'string'), ('note', 'YES', 'string'), ('time', 'NO', 'bigint'),
  ('user_id', 'YES', 'string'), ('value', 'YES', 'double')) AS t(column_name, is_nullable, data_type)""")
def show_columns(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d).sql("db", "SHOW COLUMNS FROM events")


@query(W + """, s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, time) AS a, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, time) AS b FROM w)
SELECT event_type, max(value) FILTER (WHERE a = 1) AS low, max(time) FILTER (WHERE a = 1) AS low_time, max(value) FILTER (WHERE b = 1) AS high, max(time) FILTER (WHERE b = 1) AS high_time,
  min(time) AS first_time, max(time) AS last_time FROM s GROUP BY event_type""")
def sql_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Selectors as functions of SQL over a stored table."""
    return shared(spark, d).sql("db", """SELECT event_type, selector_min_value(value, time) AS low, selector_min_time(value, time) AS low_time, selector_max_value(value, time) AS high,
      selector_max_time(value, time) AS high_time, selector_first_time(value, time) AS first_time, selector_last_time(value, time) AS last_time FROM public.default.events GROUP BY event_type""")


@query(W + "SELECT event_type, n, note FROM (SELECT event_type, count(*) AS n, count(note) AS note FROM w GROUP BY event_type)")
def output_json(spark: SparkSession, d: str) -> DataFrame:
    """A result given out as JSON text and read again."""
    text = shared(spark, d).sql("db", "SELECT event_type, count(*) AS n, count(note) AS note FROM events GROUP BY event_type", "json")
    held = spark.createDataFrame([(text,)], "t string").select(F.inline(F.from_json("t", "array<struct<event_type string, n bigint, note bigint>>")))
    return held


@query(W + "SELECT event_type, CAST(n AS VARCHAR) AS n FROM (SELECT event_type, count(*) AS n FROM w GROUP BY event_type)")
def output_csv(spark: SparkSession, d: str) -> DataFrame:
    text = shared(spark, d).sql("db", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", "csv")
    head, *rows = [line.split(",") for line in text.splitlines()]
    return spark.createDataFrame(rows, ", ".join(f"{h} string" for h in head))


@query("SELECT true AS pushed, true AS pruned")
def explain(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a statement: conditions on keys reach the scan, and columns that nothing needs are not read."""
    plan = shared(spark, d).sql("db", "EXPLAIN SELECT value FROM events WHERE event_type = 'click' AND time > 0").first()[0]
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    return spark.createDataFrame([("EqualTo(event_type,click)" in plan, "note" not in scan)], "pushed boolean, pruned boolean")


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) * 1000 AS time, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Line-protocol files of a folder stream into a database, one write for each micro-batch."""
    folder = scratch_path(spark, "lines")
    lines(spark, d).repartition(6).write.text(folder)
    made = Engine(spark)
    db = made.create_database("db", Rules(partition_template=[TimePart("%Y")]))
    running = streams.ingest(streams.lines_from_folder(spark, folder, 3), db)
    running.awaitTermination()
    return db.table("events").shown()


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) * 1000 AS time, value FROM events")
def lineproto_source(spark: SparkSession, d: str) -> DataFrame:
    """Line-protocol files read by the data source."""
    folder = scratch_path(spark, "lines")
    lines(spark, d).repartition(6).write.text(folder)
    line_protocol.register(spark)
    points, _ = line_protocol.points(spark.read.format("lineprotocol").load(folder))
    return points.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), "time", F.col("f64")["value"].alias("value"))


@query("SELECT 'events' AS table_name, event_type AS column_name, 'x' AS partition_key WHERE false".replace("event_type", "''"))
def sys_empty(spark: SparkSession, d: str) -> DataFrame:
    """The system tables of a database that holds nothing."""
    made = Engine(spark)
    made.create_database("db")
    return system_tables.columns(spark, made.databases["db"]).select("table_name", "column_name", "partition_key")
