"""Queries of the data-preparation operators p1 to p5, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import hot_keys, quarantine, regular_grid, schema_drift, small_files
from tidemark.session import cut_lineage, enough_tasks, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The column of file_columns that says whether a column is a tag, a field or the time.
ROLE = "influxdb_type"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# 1. Rows that fail to parse

# The grammar once more, for one match of the whole line. A name must not end with a backslash.
_UNIT = r"(?:[^ \t\n,\\]|\\(?s:.))"
_KEY = r"(?:[^ \t\n=\\]|\\(?s:.))*(?:[^ \t\n=\\]|\\[^\\])"
_NAME = rf"{_UNIT}*(?:[^ \t\n,\\]|\\[^\\])"
_STRING = r'"(?:[^"\\]|\\(?s:.))*"'
_VALUE = rf"(?:-?[0-9]+i|[0-9]+u|[0-9]+[eE][-+][0-9]+|-?[0-9]+(?:\.[0-9]+(?:[eE][-+][0-9]+)?)?|{_STRING}|true|True|TRUE|t|T|false|False|FALSE|f|F)"
_FIELDS = rf"(?:{_KEY}={_VALUE},?|{_KEY}={_VALUE}(?:,{_KEY}={_VALUE})+)"
_TAGS = rf"(?:,(?:{_KEY}={_NAME}(?:,{_KEY}={_NAME})*)?)?"
_LINES = r'((?:[ \t]*#[^\n]*|[ \t]*(?:[^ \n\\]|\\[^\n])*(?:="(?:[^"\\]|\\(?s:.))*(?:"|\\?\z)|\\[^\n]?|[^\n\\])*)(?:\n|\z))'
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_P1 = f"""
WITH lines AS (
  SELECT request_id, lines_written, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
  FROM (SELECT request_id, lines_written, regexp_extract_all(lp_data, {_quoted(_LINES)}, 1) AS parts FROM writes)
), bodies AS (
  SELECT request_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(regexp_replace(line, '\n$', ''), '^[ \t]+', '') AS body FROM lines
), parts AS (
  SELECT *, regexp_extract(body, {_quoted(f"^{_NAME}({_TAGS}) +({_FIELDS})(?: +(-?[0-9]+))? *$")}, ['tags', 'fields', 'at']) AS m,
    regexp_full_match(body, {_quoted(f"{_NAME}{_TAGS} +{_FIELDS}(?: +-?[0-9]+)? *")}) AS formed
  FROM bodies WHERE body <> '' AND body NOT LIKE '#%'
), judged AS (
  SELECT request_id, line_no, formed
    AND (m['at'] = '' OR TRY_CAST(m['at'] AS BIGINT) IS NOT NULL)
    AND len(list_filter(regexp_extract_all(m['fields'], {_quoted(f"(?:^|,){_KEY}=({_VALUE})")}, 1), lambda v: CASE
      WHEN regexp_full_match(v, '-?[0-9]+i') THEN TRY_CAST(left(v, -1) AS BIGINT) IS NULL
      WHEN regexp_full_match(v, '[0-9]+u') THEN TRY_CAST(left(v, -1) AS UBIGINT) IS NULL
      WHEN regexp_matches(v, '^-?[0-9]') THEN coalesce(isinf(TRY_CAST(v AS DOUBLE)), true) ELSE false END)) = 0
    AND (SELECT count(*) = count(DISTINCT k) FROM (SELECT regexp_replace(unnest(regexp_extract_all(m['tags'], {_quoted(f",({_KEY})={_NAME}")}, 1)), '\\\\([\\\\,= ])', '\\1', 'g') AS k)) AS valid
  FROM parts
)
SELECT request_id, line_no FROM judged WHERE NOT valid
UNION SELECT w.request_id, 0 FROM writes w LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE valid) AS n FROM judged GROUP BY 1) j USING (request_id)
WHERE w.lines_written IS NOT NULL AND w.lines_written <> coalesce(j.n, 0)
"""


@query(_P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.load_report(enough_tasks(table(spark, d, "writes"))).select("request_id", "line_no").distinct()


@query()
def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Each rejected line and wrong request with its reason."""
    return quarantine.load_report(enough_tasks(table(spark, d, "writes")))


@query()
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed points of all valid lines; maps are given as JSON."""
    writes = table(spark, d, "writes").select("request_id", "received_at", "db_name", "lp_data")
    valid, _ = quarantine.split_valid(quarantine.parse_lines(writes))
    points = quarantine.typed_rows(valid, default_time=F.unix_micros(F.col("received_at").cast("timestamp")) * 1000)
    return points.select("request_id", "line_no", "db_name", "measurement", *[F.to_json(c).alias(c) for c in ("tags", "i64", "u64", "f64", "str", "bool")], "time")


# 2. A few keys holding most records


@query("""
SELECT table_name, partition_key FROM readings GROUP BY ALL
HAVING count(*) * 100 > 3 * (SELECT count(*) FROM readings)
""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, d, "readings"), ["table_name", "partition_key"]).select("table_name", "partition_key")


@query("""
SELECT db_name, table_name, partition_key, count(*) AS n_rows, count(value) AS n_values, round(sum(value), 4) AS total,
       min(time) AS time_min, max(time) AS time_max
FROM readings GROUP BY ALL
""")
def p2_reading_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = hot_keys.key_totals(table(spark, d, "readings"), ["db_name", "table_name", "partition_key"], value="value")
    return totals.select("db_name", "table_name", "partition_key", F.col("rows").alias("n_rows"), F.col("values").alias("n_values"), F.round("total", 4).alias("total"), "time_min", "time_max")


@query("""
SELECT table_name, partition_key, count(*) AS n_rows, CAST(sum(row_count) AS BIGINT) AS held_rows,
       min(epoch_us(time_of_first_write)) AS first_write_us, max(epoch_us(time_of_first_write)) AS last_write_us
FROM (SELECT DISTINCT * FROM chunks) GROUP BY ALL
""")
def p2_chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").distinct().withColumn("us", F.unix_micros(F.col("time_of_first_write").cast("timestamp")))
    totals = hot_keys.key_totals(chunks, ["table_name", "partition_key"], time="us", value="row_count")
    return totals.select("table_name", "partition_key", F.col("rows").alias("n_rows"), F.col("total").cast("bigint").alias("held_rows"), F.col("time_min").alias("first_write_us"), F.col("time_max").alias("last_write_us"))


@query("""
SELECT db_name, table_name, partition_key, host, region, time, count(*) AS writes,
       arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value, max(seq) FILTER (WHERE value IS NOT NULL) AS seq
FROM readings GROUP BY ALL
""")
def p2_last_values(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.last_values(table(spark, d, "readings"), ["db_name", "table_name", "partition_key", "host", "region", "time"])


# 3. Irregular readings onto a regular grid

_P3 = """
WITH q AS (
  SELECT request_id, db_name, table_name, range_start, range_end, window_every AS e, coalesce(window_offset, 0) AS o, aggregate
  FROM window_requests WHERE range_end > range_start AND window_every > 0
), g AS (
  SELECT q.*, range_start - (((range_start - o) % e) + e) % e AS w0 FROM q
), w AS (
  SELECT g.*, unnest(generate_series(w0, range_end - 1, e)) AS w FROM g
), x AS (
  SELECT q.request_id, q.e, q.o, r.host, r.time, arg_max(r.value, r.seq) FILTER (WHERE r.value IS NOT NULL) AS value
  FROM q JOIN readings r ON r.db_name = q.db_name AND r.table_name = q.table_name AND r.time >= q.range_start AND r.time < q.range_end
  WHERE r.host IS NOT NULL GROUP BY ALL
), s AS (
  SELECT DISTINCT request_id, host FROM x
), v AS (
  SELECT request_id, host, time - (((time - o) % e) + e) % e AS w, count(*) AS n, sum(value) AS total, min(value) AS low,
         max(value) AS high, arg_max(value, time) AS last_value, max(time) AS last_time, arg_min(value, time) AS first_value, min(time) AS first_time
  FROM x WHERE value IS NOT NULL GROUP BY ALL
)
"""


@query(_P3 + """
SELECT w.request_id, s.host, w.w + w.e AS window_stop
FROM w JOIN s USING (request_id) LEFT JOIN v ON v.request_id = w.request_id AND v.host = s.host AND v.w = w.w WHERE v.n IS NULL
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid.regular_grid(table(spark, d, "readings"), table(spark, d, "window_requests"))
    return regular_grid.empty_windows(grid)


@query(_P3 + """
, f AS (
  SELECT w.request_id, s.host, w.w + w.e AS window_stop, w.e, w.aggregate, v.n, v.total, v.low, v.high, v.last_value, v.first_value,
    last_value(v.last_time IGNORE NULLS) OVER b AS t0, last_value(v.last_value IGNORE NULLS) OVER b AS v0,
    first_value(v.first_time IGNORE NULLS) OVER a AS t1, first_value(v.first_value IGNORE NULLS) OVER a AS v1
  FROM w JOIN s USING (request_id) LEFT JOIN v ON v.request_id = w.request_id AND v.host = s.host AND v.w = w.w
  WINDOW b AS (PARTITION BY w.request_id, s.host ORDER BY w.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY w.request_id, s.host ORDER BY w.w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)
SELECT request_id, host, window_stop,
  CASE WHEN n > 0 THEN 'observed' WHEN aggregate NOT IN ('count', 'sum') AND t1 - t0 <= e * 4 THEN 'interpolated' ELSE 'gap' END AS state,
  round(CASE WHEN n > 0 THEN CASE aggregate WHEN 'count' THEN n::DOUBLE WHEN 'sum' THEN total WHEN 'min' THEN low WHEN 'max' THEN high
      WHEN 'first' THEN first_value WHEN 'last' THEN last_value ELSE total / n END
    WHEN aggregate = 'count' THEN 0.0
    WHEN aggregate <> 'sum' AND t1 - t0 <= e * 4 THEN v0 + (v1 - v0) * ((window_stop - t0)::DOUBLE / (t1 - t0)) END, 9) AS value
FROM f
""")
def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every source with its value and whether it was observed, interpolated or left as a gap."""
    grid = regular_grid.regular_grid(table(spark, d, "readings"), table(spark, d, "window_requests"))
    return grid.select("request_id", "host", "window_stop", "state", F.round("value", 9).alias("value"))


# 4. Schemas that drift between files


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    statistics = schema_drift.path_statistics(schema_drift.path_values(table(spark, d, "file_records")))
    return schema_drift.ordered_files(table(spark, d, "parquet_files"), table(spark, d, "file_columns"), ROLE, statistics)


_P4 = f"""
WITH c AS (
  SELECT DISTINCT file_id, ordinal, column_name AS name, column_type AS t, {ROLE} AS r FROM file_columns
), f AS (
  SELECT *, row_number() OVER (PARTITION BY db_name, table_name ORDER BY version, creation_timestamp, file_id) AS n
  FROM (SELECT DISTINCT db_name, table_name, file_id, version, creation_timestamp FROM parquet_files WHERE file_id IN (SELECT file_id FROM c))
), p AS (
  SELECT a.db_name, a.table_name, a.file_id, a.n, b.file_id AS prev FROM f a JOIN f b ON a.db_name = b.db_name AND a.table_name = b.table_name AND a.n = b.n + 1
), fresh AS (
  SELECT p.*, c.ordinal, c.name, c.t, c.r FROM p JOIN c ON c.file_id = p.file_id
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.file_id = p.prev AND o.name = c.name)
), gone AS (
  SELECT p.*, c.ordinal, c.name, c.t, c.r FROM p JOIN c ON c.file_id = p.prev
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.file_id = p.file_id AND o.name = c.name)
), moved AS (
  SELECT fresh.file_id, fresh.name, gone.name AS old FROM fresh JOIN gone USING (file_id, ordinal)
  WHERE fresh.t IS NOT DISTINCT FROM gone.t AND fresh.r IS NOT DISTINCT FROM gone.r
)
SELECT DISTINCT file_id, column_name, change FROM (
  SELECT p.file_id, c.name AS column_name, 'retyped' AS change FROM p JOIN c ON c.file_id = p.file_id JOIN c o ON o.file_id = p.prev AND o.name = c.name
  WHERE c.t IS DISTINCT FROM o.t OR c.r IS DISTINCT FROM o.r
  UNION ALL SELECT file_id, name, CASE WHEN (file_id, name) IN (SELECT (file_id, name) FROM moved) THEN 'renamed' ELSE 'added' END FROM fresh
  UNION ALL SELECT file_id, name, 'removed' FROM gone WHERE (file_id, name) NOT IN (SELECT (file_id, old) FROM moved)
)
"""


@query(_P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(_ordered(spark, d)).select("file_id", "column_name", "change").distinct()


@query("""
SELECT file_id, k AS path, CASE json_type(json_extract(record, '$."' || k || '"')) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT'
  WHEN 'NULL' THEN 'VOID' ELSE json_type(json_extract(record, '$."' || k || '"')) END AS raw_type, count(*) AS n_values
FROM (SELECT file_id, record, unnest(json_keys(record)) AS k FROM file_records) GROUP BY ALL
""")
def p4_path_types(spark: SparkSession, d: str) -> DataFrame:
    """How often each path held each raw type, by file."""
    pairs = schema_drift.path_values(table(spark, d, "file_records"))
    return schema_drift.path_statistics(pairs).withColumnRenamed("values", "n_values")


@query()
def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every record in its table's consistent columns, with the values that could not be cast."""
    ordered = _ordered(spark, d)
    columns = schema_drift.lineages(ordered, schema_drift.schema_changes(ordered))
    return schema_drift.consistent_rows(table(spark, d, "file_records"), table(spark, d, "parquet_files"), columns)


@query()
def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every record of every database table as typed columns, with the values that could not be cast."""
    ordered = _ordered(spark, d)
    columns = cut_lineage(schema_drift.lineages(ordered, schema_drift.schema_changes(ordered)))
    return schema_drift.wide_rows(table(spark, d, "file_records"), table(spark, d, "parquet_files"), columns)


# 5. Far too many small files

_P5 = """
WITH f AS (SELECT DISTINCT * FROM parquet_files),
done AS (SELECT DISTINCT db_name, table_name, partition_key, unnest(chunks) AS chunk_id FROM compactions WHERE finished_at IS NOT NULL),
live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_name, table_name, partition_key, chunk_id ORDER BY creation_timestamp DESC, file_id DESC) AS k FROM f)
  WHERE k = 1 AND (db_name, table_name, partition_key, chunk_id) NOT IN (SELECT (db_name, table_name, partition_key, chunk_id) FROM done)
), small AS (
  SELECT *, count(*) OVER (PARTITION BY db_name, table_name, partition_key) AS n FROM live WHERE file_bytes < 1048576
)
"""


@query(_P5 + "SELECT file_id FROM small WHERE n > 1")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    live = small_files.live_files(table(spark, d, "parquet_files"), table(spark, d, "compactions"))
    return small_files.merge_plan(live).select("file_id").distinct()


@query(_P5 + """
SELECT db_name, table_name, partition_key, CAST(count(DISTINCT small.file_id) AS BIGINT) AS merged_files, count(r.row_no) AS n_rows
FROM small LEFT JOIN file_records r ON r.file_id = small.file_id WHERE n > 1 GROUP BY ALL
""")
def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """Merge the small files for real into the shared folder, publish the manifest, and report it by partition."""
    live = small_files.live_files(table(spark, d, "parquet_files"), table(spark, d, "compactions"))
    plan, records, out = cut_lineage(small_files.merge_plan(live)), table(spark, d, "file_records"), scratch_path(spark, "merged")
    manifest = cut_lineage(small_files.merge_records(plan, records, out))
    manifest = spark.read.parquet(small_files.publish(manifest, plan, records, out))
    return manifest.groupBy(*small_files.PARTITION).agg(F.sum(F.size("sources")).cast("bigint").alias("merged_files"), F.sum("n_rows").alias("n_rows"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def compact_files(spark: SparkSession, d: str) -> DataFrame:
    """Events written as many small Parquet files, compacted twice into the same folder, and read back."""
    source, out = scratch_path(spark, "small"), scratch_path(spark, "compacted")
    table(spark, d, "events").repartition(24).write.parquet(source)
    for _ in range(2):
        small_files.compact_parquet(small_files.list_files(spark, source), out)
    small_files.clean(spark, out)
    paths = [r["path"] for r in small_files.current(spark, out).select("path").toLocalIterator()]
    return spark.read.parquet(*paths).select("event_id", "ts", "user_id", "event_type", "value", "props")
