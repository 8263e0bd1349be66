"""Databases of chunks: line protocol and rows are written to open chunks, chunks are merged, persisted and read.

A table is the union of its chunks, deduplicated on (tags, time) with the last non-null value of each field. Rows carry
their write order ``_seq``. Every chunk lies in files of the shared folder, an open one too, so a lost executor loses
nothing; whether a chunk is open, closed, merged or persisted is its storage, kept with its statistics on the driver.
The log of persisted chunks is what a restart finds.

Chunks go through these storages: OpenMutableBuffer (written to), ClosedMutableBuffer, ReadBuffer (merged, deduplicated
and sorted), ReadBufferAndObjectStore (persisted and cached) and ObjectStoreOnly (persisted).
"""

from __future__ import annotations

import json

import time as clock
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.partitioning import TablePart, TimePart, partition_key
from tidemark.lifecycle.windows import PersistenceWindows
from tidemark.operators import dedup, quarantine, reorg
from tidemark.plans.predicate import Predicate
from tidemark.plans.schema import FIELD_TYPES, TIME, SchemaError, TsSchema, TsTable, logical_type
from tidemark.session import cut_lineage
from tidemark.store import statistics
from tidemark.store.log import DATA, TransactionLog
from tidemark.store.storage import Storage

# The names of the storages.
OPEN, CLOSED, BUFFER, BOTH, STORED = "OpenMutableBuffer", "ClosedMutableBuffer", "ReadBuffer", "ReadBufferAndObjectStore", "ObjectStoreOnly"
SEQ = dedup.SEQ
#: Most errors a refused write reports.
MOST_ERRORS = 10
#: Rows of one write in the write order: a write is numbered above them.
WRITE_ROWS = 1 << 40
_MAPS = {"i64": "integer", "u64": "unsigned", "f64": "float", "str": "string", "bool": "boolean"}


class WriteError(ValueError):
    """A write that was refused as a whole."""


@dataclass
class Rules:
    """What a database does with its data. Times are seconds, sizes bytes."""

    partition_template: list = field(default_factory=lambda: [TablePart(), TimePart("%Y-%m-%d %H:00:00")])
    buffer_size_soft: int | None = None
    buffer_size_hard: int | None = None
    drop_non_persisted: bool = False
    immutable: bool = False
    open_row_threshold: int = 100_000
    persist_row_threshold: int = 1_000_000
    persist_age_threshold: int = 1_800
    late_arrive_window: int = 300
    open_linger: int | None = None


@dataclass
class Chunk:
    table: str
    partition_key: str
    id: int
    storage: str
    schema: TsSchema
    parts: list[str]
    rows: int
    stats: statistics.Stats
    bytes: int = 0
    first_write: float | None = None
    last_write: float | None = None
    closed: float | None = None
    clean: bool = False  # no key occurs twice
    sort_key: list[str] | None = None
    action: str | None = None
    action_since: float | None = None
    cached: DataFrame | None = None

    @property
    def address(self) -> tuple[str, str]:
        return self.table, self.partition_key

    def note(self) -> dict[str, Any]:
        """What the log holds of a persisted chunk."""
        names = ("table", "partition_key", "id", "rows", "bytes", "stats", "sort_key", "first_write", "last_write", "closed")
        return {n: getattr(self, n) for n in names} | {"path": self.parts[0], "columns": self.schema.columns}

    @classmethod
    def of_note(cls, note: dict[str, Any]) -> Chunk:
        names = ("table", "partition_key", "id", "rows", "bytes", "stats", "sort_key", "first_write", "last_write", "closed")
        return cls(storage=STORED, schema=TsSchema(note["columns"], note["table"]), parts=[note["path"]], clean=True, **{n: note[n] for n in names})


@dataclass
class Operation:
    id: int
    description: str
    partition_key: str | None
    chunk_ids: list[int]
    status: str = "Running"
    cpu: float = 0.0
    wall: float = 0.0


@dataclass
class Db:
    spark: SparkSession
    name: str
    root: str
    rules: Rules = field(default_factory=Rules)
    now: Callable[[], float] = clock.time
    chunks: list[Chunk] = field(default_factory=list)
    schemas: dict[str, TsSchema] = field(default_factory=dict)
    windows: dict[tuple[str, str], PersistenceWindows] = field(default_factory=dict)
    operations: list[Operation] = field(default_factory=list)
    writes: int = 0

    def __post_init__(self) -> None:
        self.storage = Storage(self.spark, f"{self.root}/{self.name}")
        self.log = TransactionLog.load(self.storage)
        self._restore()

    def _restore(self) -> None:
        for note in self.log.chunks.values():
            chunk = Chunk.of_note(note)
            self.chunks.append(chunk)
            self.schemas[chunk.table] = self.schemas.get(chunk.table, TsSchema({}, chunk.table)).merge(chunk.schema)
            seq = chunk.stats.get(SEQ)
            self.writes = max(self.writes, (seq["max"] // WRITE_ROWS + 1) if seq and seq["max"] is not None else 0)

    # Writing

    def write_lines(self, lines: str | list[str] | DataFrame, default_time: int | None = None) -> int:
        """Write line protocol, given as text or as a DataFrame of one text column; the number of rows. A write with a line
        that does not parse, or that disagrees with the table's types, is refused as a whole."""
        if isinstance(lines, str | list):
            lines = self.spark.createDataFrame([(t,) for t in ([lines] if isinstance(lines, str) else lines)], "text string")
        text = lines.columns[0]
        # Lines of one text keep their order; texts are in the order of the input.
        parsed = cut_lineage(quarantine.parse_lines(lines.select(F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("_text")), "text"))
        valid, bad = quarantine.split_valid(parsed)
        if errors := bad.select("line_no", F.array_join("errors", "; ").alias("reason")).orderBy("_text", "line_no").limit(MOST_ERRORS).collect():
            raise WriteError("; ".join(f"line {e['line_no']}: {e['reason']}" for e in errors))
        when = F.lit(int(self.now() * 1e9) if default_time is None else default_time).cast("bigint")
        points = quarantine.typed_rows(valid, when).withColumn("_order", F.struct("_text", "line_no"))
        return self.write_points(points)

    def _columns(self, points: DataFrame) -> dict[str, TsSchema]:
        """The schema of every table of a batch; bounded by the schemas, not by the rows."""
        of = lambda column, kind: F.transform(F.map_keys(column), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("name")))
        kinds = [of("tags", "tag"), *(of(column, kind) for column, kind in _MAPS.items())]
        found: dict[str, TsSchema] = {}
        for row in points.select("measurement", F.explode(F.concat(*kinds)).alias("c")).distinct().select("measurement", "c.*").collect():
            one = TsSchema({row["name"]: row["kind"], TIME: "time"}, row["measurement"])
            if row["name"] == TIME or row["name"].startswith("_"):
                raise WriteError(f"no column can be called {row['name']}")
            found[row["measurement"]] = found.get(row["measurement"], one).merge(one)
        return found

    def write_points(self, points: DataFrame) -> int:
        """Write typed points (measurement, tags, i64, u64, f64, str, bool, time, and _order for the write order)."""
        self._check_limits()
        tables = self._columns(points)
        merged = {name: self.schemas.get(name, TsSchema({}, name)).merge(schema) for name, schema in tables.items()}
        held = numbered(points, "_order")
        total = 0
        for name, schema in sorted(tables.items()):
            columns = [F.col("tags")[c].alias(c) if kind == "tag" else F.col("time") if kind == "time" else F.col({v: k for k, v in _MAPS.items()}[kind])[c].alias(c) for c, kind in sorted(schema.columns.items())]
            rows = held.filter(F.col("measurement") == name).select(*columns, (F.col("_row") + self.writes * WRITE_ROWS).alias(SEQ))
            total += self._append(name, schema, rows)
        self.schemas |= merged
        self.writes += 1
        return total

    def write_table(self, name: str, table: TsTable) -> int:
        """Write rows that are a table already, in the order of their ``_seq`` if they have one."""
        self._check_limits()
        merged = self.schemas.get(name, TsSchema({}, name)).merge(replace(table.schema, measurement=name))
        held = numbered(table.df, SEQ) if SEQ in table.df.columns else numbered(table.df, None)
        rows = held.select(*[F.col(f"`{c}`") for c in sorted(table.schema.columns)], (F.col("_row") + self.writes * WRITE_ROWS).alias(SEQ))
        total = self._append(name, table.schema, rows)
        self.schemas[name] = merged
        self.writes += 1
        return total

    def _check_limits(self) -> None:
        if self.rules.immutable:
            raise WriteError(f"database {self.name} is immutable")
        if self.rules.buffer_size_hard is not None and self.buffer_size() >= self.rules.buffer_size_hard:
            raise WriteError(f"database {self.name} holds {self.buffer_size()} bytes that are not persisted")

    def _append(self, name: str, schema: TsSchema, rows: DataFrame) -> int:
        key = partition_key(self.rules.partition_template, name, rows.columns, F.col(TIME))
        folder = f"open/{uuid.uuid4().hex}"
        # Rebalancing keeps a small write in few files, and splits a partition that has most rows.
        rows.withColumn("_partition_key", key).hint("rebalance", "_partition_key").write.partitionBy("_partition_key").parquet(self.storage.uri(folder))
        written = self.spark.read.option("basePath", self.storage.uri(folder)).schema(T.StructType([*struct(schema).fields, T.StructField("_partition_key", T.StringType())])).parquet(self.storage.uri(folder))
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        parts = {unescape(n.removeprefix("_partition_key=")): f"{folder}/{n}" for n in self.storage.names(folder) if n.startswith("_partition_key=")}
        found = statistics.by_partition(written, TsSchema({**schema.columns, SEQ: "integer"}, name))
        now = self.now()
        for part, (count, stats) in found.items():
            chunk = self._open_chunk(name, part)
            if chunk is None:
                chunk = Chunk(name, part, self._next_id(name, part), OPEN, schema, [], 0, {}, first_write=now)
                self.chunks.append(chunk)
            chunk.schema = chunk.schema.merge(replace(schema, measurement=name))
            chunk.parts.append(self.storage.uri(parts[part]))
            chunk.rows += count
            chunk.stats = statistics.merged(chunk.stats, stats) if chunk.stats else stats
            chunk.bytes += self.storage.size(parts[part])
            chunk.last_write = now
            window = self.windows.setdefault((name, part), PersistenceWindows(self.rules.late_arrive_window))
            window.add_range((0, self.writes), count, stats[TIME]["min"], stats[TIME]["max"], now)
            if chunk.rows >= self.rules.open_row_threshold:
                self._close(chunk)
        return sum(count for count, _ in found.values())

    # Chunks

    def _of(self, table: str | None = None, partition: str | None = None) -> list[Chunk]:
        return [c for c in self.chunks if table in (None, c.table) and partition in (None, c.partition_key)]

    def _open_chunk(self, table: str, partition: str) -> Chunk | None:
        return next((c for c in self._of(table, partition) if c.storage == OPEN and c.action is None), None)

    def _next_id(self, table: str, partition: str) -> int:
        return max((c.id for c in self._of(table, partition)), default=-1) + 1

    def chunk(self, table: str, partition: str, number: int) -> Chunk:
        found = [c for c in self._of(table, partition) if c.id == number]
        if not found:
            raise KeyError(f"no chunk {number} in {table}, {partition}")
        return found[0]

    def partitions(self) -> list[tuple[str, str]]:
        return sorted({c.address for c in self.chunks})

    def buffer_size(self) -> int:
        """Bytes of chunks that are not, or not only, persisted."""
        return sum(c.bytes for c in self.chunks if c.storage != STORED)

    def _close(self, chunk: Chunk) -> None:
        chunk.storage, chunk.closed = CLOSED, self.now()

    def rollover(self, table: str, partition: str) -> Chunk | None:
        """Close the open chunk of a partition; the next write opens another."""
        chunk = self._open_chunk(table, partition)
        if chunk is not None:
            self._close(chunk)
        return chunk

    def drop(self, chunk: Chunk) -> None:
        """Forget a chunk and its data."""
        if chunk.action:
            raise RuntimeError(f"chunk {chunk.id} is {chunk.action}")
        if chunk.storage in (BOTH, STORED):
            self.log.commit(remove=chunk.parts)
        self._remove([chunk])

    def _remove(self, chunks: list[Chunk]) -> None:
        gone = {id(c) for c in chunks}
        self.chunks = [c for c in self.chunks if id(c) not in gone]
        for c in chunks:
            if c.cached is not None:
                c.cached.unpersist()
            for part in c.parts:
                self.storage.delete(self.storage.relative(part))

    # Reading

    def schema(self, table: str) -> TsSchema:
        if table not in self.schemas:
            raise SchemaError(f"no table {table}")
        return self.schemas[table]

    def _read(self, chunks: list[Chunk], schema: TsSchema) -> TsTable:
        """Chunks in one scan; columns that a chunk lacks are null in its rows."""
        cached = [c for c in chunks if c.cached is not None]
        paths = [p for c in chunks if c.cached is None for p in c.parts]
        fields = struct(schema)
        df = self.spark.read.schema(fields).parquet(*paths) if paths else self.spark.createDataFrame([], fields)
        for c in cached:
            df = df.unionByName(c.cached, allowMissingColumns=True)
        return TsTable(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields.fields]), schema)

    def candidates(self, table: str, predicate: Predicate = Predicate()) -> list[Chunk]:
        """Chunks that may hold rows the predicate is about, by partition key and by the bounds of their key columns."""
        schema = self.schema(table)
        found = [c for c in self._of(table) if predicate.partition_key in (None, c.partition_key)]
        return [c for c in found if statistics.key_match(predicate, schema, c.stats, c.rows) != statistics.NONE]

    def table(self, table: str, predicate: Predicate = Predicate(), chunks: list[Chunk] | None = None) -> TsTable:
        """The deduplicated table, of the chunks the predicate may find rows in. Chunks without duplicates that overlap no
        other are read plainly, all others through one aggregate for each group."""
        schema = self.schema(table)
        chosen = self.candidates(table, predicate) if chunks is None else chunks
        plain, groups = [], []
        for group in dedup.overlap_groups([statistics.bounds(schema, c.stats) for c in chosen]):
            if len(group) == 1 and chosen[group[0]].clean:
                plain.append(chosen[group[0]])
            else:
                groups.append([chosen[i] for i in group])
        # Groups have no key in common, so one aggregate over all of them gives what one for each would.
        shared = [c for g in groups for c in g]
        if not shared:
            return self._read(plain, schema)
        merged = dedup.dedup_last_non_null(self._read(shared, schema))
        if not plain:
            return merged
        return TsTable(merged.df.unionByName(self._read(plain, schema).df), schema)

    def tables(self) -> dict[str, TsTable]:
        return {name: self.table(name) for name in sorted(self.schemas)}

    # Jobs

    @contextmanager
    def _job(self, what: str, chunks: list[Chunk]) -> Iterable[Operation]:
        """Marks chunks with what is done to them. If it fails the marks stay until :meth:`clear_failed`."""
        if busy := [c.id for c in chunks if c.action]:
            raise RuntimeError(f"chunks are in use: {busy}")
        began, cpu = clock.perf_counter(), clock.process_time()
        job = Operation(len(self.operations), what, chunks[0].partition_key if chunks else None, [c.id for c in chunks])
        self.operations.append(job)
        for c in chunks:
            c.action, c.action_since = what, self.now()
        try:
            yield job
            job.status = "Complete"
            for c in chunks:
                c.action = c.action_since = None
        except BaseException:
            job.status = "Failed"
            raise
        finally:
            job.wall, job.cpu = clock.perf_counter() - began, clock.process_time() - cpu

    def clear_failed(self, since: float) -> int:
        """Free the chunks of jobs that failed at or before ``since``."""
        running = {i for o in self.operations if o.status == "Running" for i in o.chunk_ids}
        stuck = [c for c in self.chunks if c.action and c.action_since <= since and c.id not in running]
        for c in stuck:
            c.action = c.action_since = None
        return len(stuck)

    def _write(self, folder: str, table: TsTable, source: list[Chunk], storage: str, key: list[str]) -> Chunk | None:
        """Rows of one partition as a new chunk; None if there are none."""
        first = source[0]
        name = f"{folder}/{uuid.uuid4().hex}"
        table.df.write.parquet(self.storage.uri(name))
        written = self.spark.read.schema(struct(table.schema)).parquet(self.storage.uri(name)).withColumn("_partition_key", F.lit(first.partition_key))
        found = statistics.by_partition(written, TsSchema({**table.schema.columns, SEQ: "integer"}, first.table))
        if not found:
            self.storage.delete(name)
            return None
        rows, stats = found[first.partition_key]
        times = [c.first_write for c in source if c.first_write is not None], [c.last_write for c in source if c.last_write is not None]
        return Chunk(first.table, first.partition_key, self._next_id(*first.address), storage, table.schema, [self.storage.uri(name)], rows, stats, self.storage.size(name),
                     min(times[0], default=None), max(times[1], default=None), self.now(), True, key)

    def _sorted(self, chunks: list[Chunk]) -> tuple[TsTable, list[str]]:
        schema = self.schema(chunks[0].table)
        stats: statistics.Stats = {}
        for c in chunks:
            stats = statistics.merged(stats, c.stats) if stats else c.stats
        key = [*sorted(schema.tags, key=lambda t: (stats.get(t, {}).get("distinct", 0), t)), TIME]
        return reorg.compact([self._read(chunks, schema)], key)

    def compact(self, chunks: list[Chunk]) -> Chunk | None:
        """Chunks of one partition as one merged chunk; the inputs are dropped."""
        self._check_together(chunks)
        with self._job("Compacting", chunks):
            done, key = self._sorted(chunks)
            made = self._write("buffer", done, chunks, BUFFER, key)
        self._swap(chunks, [made])
        return made

    def _check_together(self, chunks: list[Chunk]) -> None:
        if not chunks or len({c.address for c in chunks}) != 1:
            raise ValueError("chunks must be of one partition")
        if any(c.storage in (BOTH, STORED) for c in chunks):
            raise ValueError("persisted chunks are not merged")

    def _swap(self, old: list[Chunk], new: list[Chunk | None]) -> None:
        """New chunks appear before the old ones' data goes."""
        self.chunks += [c for c in new if c is not None]
        self._remove(old)

    def persist(self, chunks: list[Chunk], flush_time: int | None = None) -> tuple[Chunk | None, Chunk | None]:
        """Chunks of one partition merged and split at ``flush_time``: rows up to it are persisted, the rest is a merged
        chunk. (persisted, rest)."""
        self._check_together(chunks)
        with self._job("Persisting", chunks):
            done, key = self._sorted(chunks)
            if flush_time is None:
                early, late = done.df, None
            else:
                from tidemark.operators.pivot import stream_split

                early, late = stream_split(cut_lineage(done.df), F.col(TIME) <= flush_time)
            made = self._write(DATA, TsTable(early, done.schema), chunks, STORED, key)
            rest = None if late is None else self._write("buffer", TsTable(late, done.schema), chunks, BUFFER, key)
            if made is not None and rest is not None:
                rest.id = made.id + 1
            if made is not None:
                self._commit(made)
        self._swap(chunks, [made, rest])
        return made, rest

    def _commit(self, chunk: Chunk) -> None:
        note = chunk.note()
        self.storage.create(f"{self.storage.relative(chunk.parts[0])}.json", json.dumps(note))
        self.log.commit(add=[json.loads(json.dumps(note))])

    def move(self, chunk: Chunk) -> Chunk | None:
        """A closed chunk becomes a merged one."""
        if chunk.storage == OPEN:
            self._close(chunk)
        return self.compact([chunk])

    def write_to_store(self, chunk: Chunk) -> Chunk:
        """Persist a merged chunk as it is, and keep it cached."""
        if chunk.storage != BUFFER:
            raise ValueError(f"chunk {chunk.id} is {chunk.storage}")
        with self._job("Writing", [chunk]):
            name = f"{DATA}/{uuid.uuid4().hex}"
            self._read([chunk], chunk.schema).df.write.parquet(self.storage.uri(name))
            old, chunk.parts = chunk.parts, [self.storage.uri(name)]
            self._commit(chunk)
        self.load(chunk)
        for part in old:
            self.storage.delete(self.storage.relative(part))
        return chunk

    def load(self, chunk: Chunk) -> None:
        """Cache a persisted chunk in executors' memory."""
        chunk.cached = self._read([chunk], chunk.schema).df.cache()
        chunk.storage = BOTH

    def unload(self, chunk: Chunk) -> None:
        """Give the memory of a persisted chunk back."""
        if chunk.storage != BOTH:
            raise ValueError(f"chunk {chunk.id} is {chunk.storage}")
        if chunk.cached is not None:
            chunk.cached.unpersist()
        chunk.cached, chunk.storage = None, STORED


def struct(schema: TsSchema) -> T.StructType:
    """The schema's columns in name order, and the write order."""
    kinds = {"tag": T.StringType(), "time": T.LongType()} | FIELD_TYPES
    return T.StructType([*(T.StructField(c, kinds[schema.columns[c]]) for c in sorted(schema.columns)), T.StructField(SEQ, T.LongType())])


def numbered(df: DataFrame, order: str | None) -> DataFrame:
    """``df`` with ``_row``, the place of each row in ``order``, or as it lies. Rows are written once, and a place is the
    row's place in its slice and the number of rows before the slice; only a number for each slice comes to the driver."""
    sliced = df if order is None else df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    held = cut_lineage(sliced.withColumn("_id", F.monotonically_increasing_id()))
    width = 1 << 33
    counts = held.groupBy(F.shiftright("_id", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
    before, starts = 0, []
    for slice_, n in counts:
        starts.append((slice_, before))
        before += n
    if before >= WRITE_ROWS:
        raise WriteError(f"{before} rows are too many for one write")
    known = df.sparkSession.createDataFrame(starts, "_slice bigint, _before bigint")
    joined = held.withColumn("_slice", F.shiftright("_id", 33)).join(F.broadcast(known), "_slice")  # one row for each task of the write
    return joined.withColumn("_row", F.pmod("_id", F.lit(width)) + F.col("_before")).drop("_id", "_slice", "_before")
