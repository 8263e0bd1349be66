"""System tables: chunks, columns, chunk columns and operations, and the information schema."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.schema import TsSchema, TsTable

if TYPE_CHECKING:
    from tidemark.store.database import Db

# The columns of the system tables.
CHUNKS = "id bigint, partition_key string, table_name string, storage string, lifecycle_action string, estimated_bytes bigint, row_count bigint, time_of_first_write timestamp, time_of_last_write timestamp, time_closed timestamp"
COLUMNS = "partition_key string, table_name string, column_name string, column_type string, role string"
CHUNK_COLUMNS = "partition_key string, chunk_id bigint, table_name string, column_name string, storage string, row_count bigint, min_value string, max_value string, estimated_bytes bigint"
OPERATIONS = "id string, status string, cpu_time_used bigint, wall_time_used bigint, partition_key string, chunk_id bigint, description string"
# Names of the types in the system tables and in SQL.
KIND_NAMES = {"tag": "String", "time": "Time", "float": "F64", "integer": "I64", "unsigned": "U64", "string": "String", "boolean": "Bool"}
SQL_TYPES = {"tag": "string", "time": "bigint", "float": "double", "integer": "bigint", "unsigned": "decimal(20,0)", "string": "string", "boolean": "boolean"}
ROLE_NAMES = {"tag": "Tag", "field": "Field", "time": "Timestamp"}


def chunk_columns(df: DataFrame, table: TsTable, name: str, storage: str) -> DataFrame:
    """Statistics of every column of every (partition_key, chunk_id): non-null rows, and the least and largest value
    (NaN left out) as text. One aggregate over all columns, then one row for each."""
    columns = sorted(table.schema.columns)
    outputs = []
    for i, column in enumerate(columns):
        c = F.col(f"`{column}`")
        kept = F.when(~F.isnan(c), c) if table.schema.columns[column] == "float" else c
        outputs += [F.count(c).alias(f"n{i}"), F.min(kept).cast("string").alias(f"a{i}"), F.max(kept).cast("string").alias(f"b{i}")]
    wide = df.groupBy("partition_key", "chunk_id").agg(*outputs)
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("row_count"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value")) for i, c in enumerate(columns)]
    long = wide.select("partition_key", "chunk_id", F.inline(F.array(*entries)))
    return long.select("partition_key", "chunk_id", F.lit(name).alias("table_name"), "column_name", F.lit(storage).alias("storage"), "row_count", "min_value", "max_value", F.lit(None).cast("bigint").alias("estimated_bytes"))


def chunks(spark: SparkSession, db: Db) -> DataFrame:
    """``system.chunks`` of a database."""
    when = lambda t: None if t is None else datetime.fromtimestamp(t, UTC)
    rows = [(c.id, c.partition_key, c.table, c.storage, c.action, c.bytes, c.rows, when(c.first_write), when(c.last_write), when(c.closed)) for c in db.chunks]
    return spark.createDataFrame(rows, CHUNKS)


def known_chunk_columns(spark: SparkSession, db: Db) -> DataFrame:
    """``system.chunk_columns`` of a database, from the statistics it keeps. No data is read."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [(c.partition_key, c.id, c.table, name, c.storage, s["count"], text(s["min"]), text(s["max"]), None) for c in db.chunks for name, s in sorted(c.stats.items()) if name in c.schema.columns]
    return spark.createDataFrame(rows, CHUNK_COLUMNS)


def columns(spark: SparkSession, db: Db) -> DataFrame:
    """``system.columns``: the columns of each (table, partition)."""
    seen: dict[tuple[str, str], TsSchema] = {}
    for c in db.chunks:
        seen[c.address] = seen.get(c.address, c.schema).merge(c.schema)
    rows = [(part, name, column, KIND_NAMES[schema.columns[column]], ROLE_NAMES[schema.role(column)]) for (name, part), schema in sorted(seen.items()) for column in sorted(schema.columns)]
    return spark.createDataFrame(rows, COLUMNS)


def operations(spark: SparkSession, db: Db) -> DataFrame:
    """``system.operations``: the jobs of a database since its start; a row for each chunk of a job. Times are in ns."""
    rows = [(str(o.id), o.status, int(o.cpu * 1e9), int(o.wall * 1e9), o.partition_key, i, o.description) for o in db.operations for i in o.chunk_ids]
    return spark.createDataFrame(rows, OPERATIONS)


SYSTEM = {"chunks": chunks, "columns": columns, "chunk_columns": known_chunk_columns, "operations": operations}


def information_columns(spark: SparkSession, schemas: dict[str, TsSchema], catalog: str = "public", schema: str = "default") -> DataFrame:
    """``information_schema.columns``: tables' columns in name order."""
    rows = []
    for name in sorted(schemas):
        for at, c in enumerate(sorted(schemas[name].columns)):
            kind = schemas[name].columns[c]
            rows.append((catalog, schema, name, c, at, "NO" if kind == "time" else "YES", SQL_TYPES[kind], schemas[name].role(c)))
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string, role string")


def information_tables(spark: SparkSession, schemas: dict[str, list[str]], catalog: str = "public") -> DataFrame:
    """``information_schema.tables``: of each schema its tables, and the views of the system and information schemas."""
    views = {"system": sorted(SYSTEM), "information_schema": ["columns", "tables"]}
    rows = [(catalog, schema, name, "BASE TABLE") for schema in sorted(schemas) for name in sorted(schemas[schema])]
    rows += [(catalog, schema, name, "BASE TABLE" if schema == "system" else "VIEW") for schema in views for name in views[schema]]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def observed(tables: dict[str, DataFrame]) -> DataFrame | None:
    """One system table of many databases, with the database's name in front."""
    parts = [df.select(F.lit(db).alias("database_name"), *df.columns) for db, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts) if parts else None
