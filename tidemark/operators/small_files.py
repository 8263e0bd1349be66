"""Far too many small files: fewer, well-sized ones that hold every record exactly once.

Files are assigned to a fixed number of output groups per partition by balanced longest-first scheduling: sorted by
size, each goes to the least loaded group, kept in a heap. Groups are then streamed through pyarrow, one file at a
time and batch by batch, into new files; what was written is verified against what was to be read, by rows and by an
order-free checksum, and only then published: the manifest is written under a name of its own, and one small pointer file,
which is replaced as a whole, names the current one. A folder can be written to again and again; readers see the manifest
before or after. The manifest lists each file's sources, so that readers know what it stands for, and groups without any
record have a line without a file. What no manifest names (files of lost or failed attempts, and of manifests that were
replaced) is removed by :func:`clean`. One writer at a time is assumed.

A partition may hold a third of all files: its sorted list is dealt round-robin into sublists of at most ``SUBLIST``
files, which are scheduled apart; as sizes are dealt evenly, sublists are as balanced as one list would be.

Defined cases: repeated rows count once; null sizes are 0 bytes; files without records give no rows but are merged
away like others, and are listed as sources; unfinished compactions and unknown chunk ids change nothing; an empty table gives an empty plan.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ranking import with_position
from tidemark.session import cut_lineage

PARTITION = ["db_name", "table_name", "partition_key"]
#: Files below this size are small.
SMALL = 1 << 20
#: Size of an output file that groups are planned for.
TARGET = 128 << 20
#: Most files that one call of the scheduler sees.
SUBLIST = 8192


def live_files(files: DataFrame, compactions: DataFrame) -> DataFrame:
    """The latest file of each chunk, without chunks that a finished compaction of their partition lists."""
    c = F.col
    rank = F.struct("creation_timestamp", "file_id")
    row = F.struct("version", "file_bytes", "row_count")
    latest = files.distinct().groupBy(*PARTITION, "chunk_id").agg(F.max(rank).alias("r"), F.max_by(row, rank).alias("x"))
    done = compactions.filter(c("finished_at").isNotNull()).select(*PARTITION, F.explode("chunks").alias("chunk_id")).distinct()
    live = latest.join(done, [*PARTITION, "chunk_id"], "left_anti")
    return live.select(*PARTITION, "chunk_id", "r.file_id", "r.creation_timestamp", "x.version", F.coalesce("x.file_bytes", F.lit(0)).alias("file_bytes"), "x.row_count")


def longest_first(sizes: list[int], groups: int) -> list[int]:
    """The group of each file: files by falling size, each to the least loaded group."""
    heap = [(0, g) for g in range(groups)]
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        placed[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return placed


def merge_plan(live: DataFrame, small: int = SMALL, target: int = TARGET) -> DataFrame:
    """(db_name, table_name, partition_key, file_id, file_bytes, group_id) of the files to be merged: the small files of
    every partition that has two or more."""
    if target < 4 * small:
        raise ValueError("the target must be several times the size of a small file")
    c = F.col
    candidates = live.filter(c("file_bytes") < small).select(*PARTITION, "file_id", "file_bytes")
    placed = with_position(candidates, PARTITION, [c("file_bytes").desc(), c("file_id").asc()], size="_files").filter(c("_files") > 1)
    lists = F.ceil(c("_files") / SUBLIST)
    dealt = placed.withColumn("_list", F.pmod("position", lists)).select(*PARTITION, "file_id", "file_bytes", "_list")

    tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lists = dealt.repartition(tasks, *PARTITION, "_list").sortWithinPartitions(*PARTITION, "_list")
    schema = dealt.drop("_list").schema.add("group_id", "string")
    return sorted_lists.mapInArrow(_schedule(target), schema)


def _schedule(target: int):  # noqa: ANN202
    """Sublists come one after the other; each is scheduled as it ends. Many are tiny, so they are not grouped by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def placed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sizes = whole.column("file_bytes").to_pylist()
            groups = longest_first(sizes, max(1, math.ceil(sum(sizes) / target)))
            names = [f"{key[-1]}-{g}" for g in groups]
            return whole.drop_columns(["_list"]).append_column("group_id", pa.array(names, pa.string())).to_batches()[0]

        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*PARTITION, "_list")), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key:
                    if held:
                        out.append(placed())
                    held, key = [], keys[start]
                held.append(batch.slice(start, end - start))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield placed()

    return run


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") or "://" not in uri:  # Hadoop writes file:/a where pyarrow expects file:///a
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _open(root: str, name: str, schema: pa.Schema) -> tuple[pq.ParquetWriter, str, str]:
    """A writer under a name of this attempt's own; a lost or repeated task leaves only files no manifest names."""
    final = f"{root}/{name}-{uuid.uuid4().hex}.parquet"
    fs, path = _filesystem(final)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd"), final, path


def merge_records(plan: DataFrame, records: DataFrame, out_dir: str) -> DataFrame:
    """Manifest rows of the new files: group, path, rows and checksum. ``records`` has file_id, row_no and record.

    Rows of a group come sorted together, and are streamed into the group's file as they come. The mark of a row is
    computed before the shuffle, so that the sum over a file proves that its rows arrived whole.
    """
    rows = records.select("file_id", "row_no", "record", F.xxhash64("file_id", "row_no", "record").alias("_mark"))
    keyed = rows.join(plan.select(*PARTITION, "group_id", "file_id"), "file_id")
    sorted_rows = keyed.repartition(*PARTITION, "group_id").sortWithinPartitions(*PARTITION, "group_id", "file_id", "row_no")
    kept = pa.schema([("file_id", pa.int64()), ("row_no", pa.int32()), ("record", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, key, final, n, mark = None, None, "", 0, 0
        made: list[tuple] = []

        def close() -> None:
            if writer is not None:
                writer.close()
                made.append((*key, final, n, mark))

        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*PARTITION, "group_id")), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key:
                    close()
                    key, n, mark = keys[start], 0, 0
                    writer, final, _ = _open(out_dir, "part", kept)
                part = batch.slice(start, end - start)
                writer.write_table(pa.Table.from_batches([part.select(kept.names)]).cast(kept))
                n += part.num_rows
                mark = (mark + sum(part.column(part.schema.get_field_index("_mark")).to_pylist())) % (1 << 62)
        close()
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip((*PARTITION, "group_id", "path", "n_rows", "mark"), m, strict=True)) for m in made])

    schema = ", ".join(f"{k} string" for k in (*PARTITION, "group_id", "path")) + ", n_rows bigint, mark bigint"
    return sorted_rows.mapInArrow(write, schema)


class Unverified(RuntimeError):
    """What was written is not what was to be read; nothing was published."""


def expected_marks(plan: DataFrame, records: DataFrame) -> DataFrame:
    """Rows and checksum of each group, from the records as they are."""
    marks = records.select("file_id", F.xxhash64("file_id", "row_no", "record").alias("m")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m").cast("decimal(38,0)")).alias("m"))
    summed = plan.join(marks, "file_id").groupBy(*PARTITION, "group_id").agg(F.sum("n").alias("want_rows"), F.sum("m").alias("m"))
    return summed.select(*PARTITION, "group_id", "want_rows", F.pmod("m", F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint").alias("want_mark"))


POINTER = "_current.json"


def _put(root: str, name: str, text: str) -> None:
    """A small file that appears, or is replaced, as a whole: by a rename in file systems, by the upload in object stores."""
    fs, path = _filesystem(f"{root}/{name}")
    in_place = fs.type_name in ("local", "hdfs")
    target = f"{path}.{uuid.uuid4().hex}" if in_place else path
    with fs.open_output_stream(target) as out:
        out.write(text.encode())
    if in_place:
        fs.move(target, path)


def _pointer(root: str) -> dict | None:
    fs, path = _filesystem(f"{root}/{POINTER}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as held:
        return json.loads(held.read())


def _publish(manifest: DataFrame, out_dir: str) -> str:
    """Write the manifest under a new name and point to it. ``manifest`` must be materialised."""
    before = _pointer(out_dir)
    version = before["version"] + 1 if before else 1
    name = f"manifest-{version:08d}-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{out_dir}/{name}")
    _put(out_dir, POINTER, json.dumps({"version": version, "manifest": name}))
    return f"{out_dir}/{name}"


def current(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The current manifest of a folder; None if nothing was published there."""
    held = _pointer(out_dir)
    return spark.read.parquet(f"{out_dir}/{held['manifest']}") if held else None


def clean(spark: SparkSession, out_dir: str) -> int:
    """Remove the files and manifests that the current manifest does not name; the number removed. Readers of an older
    manifest, and writers, must have ended."""
    held = _pointer(out_dir)
    if held is None:
        return 0
    fs, root = _filesystem(out_dir)
    found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith(("part-", "manifest-", ".manifest-"))]
    # Names are few for each large file; they are compared in Spark all the same, as old files may be many.
    listed = spark.createDataFrame([(f.base_name, f.path, f.type == pafs.FileType.Directory) for f in found], "name string, path string, folder boolean")
    kept = spark.read.parquet(f"{out_dir}/{held['manifest']}").filter("path IS NOT NULL").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    removed = 0
    for row in listed.filter(F.col("name") != held["manifest"]).join(kept, "name", "left_anti").toLocalIterator():
        fs.delete_dir(row["path"]) if row["folder"] else fs.delete_file(row["path"])
        removed += 1
    return removed


def publish(manifest: DataFrame, plan: DataFrame, records: DataFrame, out_dir: str) -> str:
    """Check the written files against their sources, read back their footers, and publish the manifest, with the sources
    of each group. ``manifest`` must be materialised (it is the result of writing)."""
    want = expected_marks(plan, records)
    both = manifest.join(want, [*PARTITION, "group_id"], "full")
    wrong = both.filter(~(F.col("n_rows").eqNullSafe(F.col("want_rows")) & F.col("mark").eqNullSafe(F.col("want_mark"))))
    short = manifest.mapInArrow(_footers, "path string, bad boolean").filter("bad")
    first = wrong.select("group_id").limit(1).collect() or short.select("path").limit(1).collect()
    if first:
        raise Unverified(f"group or file {first[0][0]} does not hold its records; nothing was published")
    # A group has no more files than a sublist.
    sources = plan.groupBy(*PARTITION, "group_id").agg(F.array_sort(F.collect_list("file_id")).alias("sources"))
    listed = sources.join(manifest, [*PARTITION, "group_id"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return _publish(listed, out_dir)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, want = batch.column("path").to_pylist(), batch.column("n_rows").to_pylist()
        bad = []
        for p, n in zip(paths, want, strict=True):
            fs, at = _filesystem(p)
            bad.append(pq.read_metadata(at, filesystem=fs).num_rows != n)
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "bad": pa.array(bad, pa.bool_())})


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_bytes) of the Parquet files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", F.col("length").alias("file_bytes"))


def compact_parquet(files: DataFrame, out_dir: str, target: int = TARGET, small: int = SMALL) -> str:
    """Consolidate real Parquet files: ``files`` has path and file_bytes. Returns the manifest's path (see :func:`current`).

    Files of one directory form a partition and must share a schema. Each group is streamed through pyarrow by one
    task, which holds one row group at a time; paths travel, not rows, so nothing is shuffled but the list of files.
    Files that are not small, or alone in their directory, are listed in the manifest as they are.
    """
    spark = files.sparkSession
    c = F.col
    listed = files.select(
        F.lit("").alias("db_name"), F.lit("").alias("table_name"), F.regexp_replace("path", "/[^/]*$", "").alias("partition_key"),
        c("path").alias("file_id"), c("file_bytes").cast("bigint").alias("file_bytes"),
    ).distinct()
    plan = merge_plan(listed, small, target)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(pdf["file_id"])
        fs, at = _filesystem(paths[0])
        writer, final, _ = _open(out_dir, "part", pq.read_schema(at, filesystem=fs))
        want = n = 0
        for p in paths:
            fs, at = _filesystem(p)
            with fs.open_input_file(at) as handle:
                source = pq.ParquetFile(handle)
                want += source.metadata.num_rows
                for batch in source.iter_batches():
                    writer.write_batch(batch)
                    n += batch.num_rows
        writer.close()
        return pd.DataFrame({"path": [final], "n_rows": [n], "want_rows": [want], "sources": [json.dumps(paths)], "partition_key": pdf["partition_key"][:1].tolist()})

    merged = plan.groupBy("partition_key", "group_id").applyInPandas(merge, "path string, n_rows bigint, want_rows bigint, sources string, partition_key string")
    kept = listed.join(plan.select("file_id"), "file_id", "left_anti").select(c("file_id").alias("path"), F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("want_rows"), F.lit(None).cast("string").alias("sources"), "partition_key")
    written = cut_lineage(merged.unionByName(kept))
    if bad := written.filter("n_rows <> want_rows").limit(1).collect():
        raise Unverified(f"{bad[0]['path']} does not hold its records; nothing was published")
    if bad := written.filter("sources is not null").mapInArrow(_footers, "path string, bad boolean").filter("bad").limit(1).collect():
        raise Unverified(f"{bad[0]['path']} cannot be read back whole; nothing was published")
    return _publish(written.drop("want_rows"), out_dir)
