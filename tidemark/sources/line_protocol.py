"""Line-protocol files as a Spark data source: ``spark.read.format("lineprotocol").load(folder)``, and ``readStream``.

A file is streamed by one task, cut into logical lines (a line break inside a quoted value belongs to the value), and its
lines come as Arrow batches of (path, line_no, line). Parsing them is left to the JVM's expressions; see :func:`points`.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidemark.operators import quarantine

#: Characters read at a time, and lines in a batch.
BLOCK, LINES = 1 << 20, 10_000


def logical_lines(blocks: Iterator[str]) -> Iterator[str]:
    """Lines without their line break. A string opens with ``="`` in the part of the line with the fields, that is after
    the first space that is not escaped, and ends at the next quote that is not escaped. Comments hold no strings."""
    held = ""
    done = False
    at = start = 0
    blocks = iter(blocks)
    quoted = fields = comment = begun = False
    while True:
        if at + 1 >= len(held) and not done:  # one character of look-ahead
            held, at, start = held[start:], at - start, 0
            block = next(blocks, None)
            done = block is None
            held += block or ""
            continue
        if at >= len(held):
            break
        c = held[at]
        if quoted:
            at += 2 if c == "\\" else 1
            quoted = c != '"' or False
            continue
        if c == "\n":
            yield held[start:at]
            start = at = at + 1
            fields = comment = begun = False
            continue
        if comment:
            at += 1
            continue
        if not begun and c not in " \t":
            begun, comment = True, c == "#"
        elif begun and c == " ":
            fields = True
        if c == "\\" and at + 1 < len(held) and held[at + 1] != "\n":
            at += 2
        elif fields and c == "=" and held[at + 1 : at + 2] == '"':
            quoted = True
            at += 2
        else:
            at += 1
    if start < len(held):
        yield held[start:]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The file, or the files of the folder, in the order of their names; hidden ones left out. Any file system pyarrow
    knows by its URI will do."""
    fs, at = _filesystem(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    fs, at = _filesystem(path)
    with io.TextIOWrapper(fs.open_input_file(at), encoding="utf-8", errors="replace", newline="") as held:
        number, lines = 0, []
        for line in logical_lines(iter(lambda: held.read(BLOCK), "")):
            lines.append(line)
            if len(lines) == LINES:
                yield _batch(path, number, lines)
                number, lines = number + len(lines), []
        if lines:
            yield _batch(path, number, lines)


def _batch(path: str, before: int, lines: list[str]) -> pa.RecordBatch:
    numbers = pa.array(range(before + 1, before + len(lines) + 1), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), numbers, pa.array(lines, pa.string())], names=["path", "line_no", "line"])


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class LineReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [File(f) for f in _files(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(partition.path)


class LineStreamReader(SimpleDataSourceStreamReader):
    """New files of a folder in the order of their names; a file must be whole when its name appears."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def _rows(self, low: str, high: str | None) -> tuple[list[tuple], str]:
        files = [f for f in _files(self.path) if f > low and (high is None or f <= high)]
        rows = [tuple(r.values()) for f in files for b in _batches(f) for r in b.to_pylist()]
        return rows, files[-1] if files else low

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, last = self._rows(start["last"], None)
        return iter(rows), {"last": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start["last"], end["last"])[0])


class LineProtocol(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineprotocol"

    def schema(self) -> str:
        return "path string, line_no int, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineProtocol)


def points(lines: DataFrame, default_time: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed points, rejected lines) of what the source reads; line numbers are those of the files."""
    parsed = quarantine.parse_lines(lines.withColumnRenamed("line_no", "_line_no"), "line").drop("line_no").withColumnRenamed("_line_no", "line_no")
    valid, bad = quarantine.split_valid(parsed)
    return quarantine.typed_rows(valid, default_time), bad.select("path", "line_no", "body", "errors")
