"""Ways in from outside the process: a WSGI application for writes and SQL over HTTP, and an Arrow Flight server.

Both are thin: a request becomes one call of the engine, which runs on the driver and distributes the work. Only results
that clients asked for pass through it, as a stream.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import parse_qs, unquote

import pyarrow as pa
from pyspark.errors import PySparkException

from tidemark.engine import Engine, render
from tidemark.plans.schema import SchemaError
from tidemark.store.database import WriteError

#: Most bytes of one write, before and after decompression.
MAX_WRITE = 10_485_760
_TYPES = {"json": "application/json", "csv": "text/csv", "pretty": "text/plain"}


class HttpError(Exception):
    def __init__(self, status: str, message: str) -> None:
        super().__init__(message)
        self.status = status


def database_name(org: str, bucket: str) -> str:
    """The database of an organisation's bucket; all but ASCII letters and digits is percent-encoded in both parts."""
    if not org or not bucket:
        raise HttpError("400 Bad Request", "org and bucket are needed")
    encode = lambda text: "".join(chr(b) if chr(b).isascii() and chr(b).isalnum() else f"%{b:02X}" for b in text.encode())
    return f"{encode(org)}_{encode(bucket)}"


def body_text(body: bytes, encoding: str = "identity") -> str:
    """The text of a write, decompressed if it is gzip, within the limit."""
    if encoding == "gzip":
        reader = zlib.decompressobj(wbits=31)
        try:
            body = reader.decompress(body, MAX_WRITE + 1)
        except zlib.error as problem:
            raise HttpError("400 Bad Request", f"not gzip: {problem}") from problem
        if not reader.eof and len(body) <= MAX_WRITE:
            raise HttpError("400 Bad Request", "not whole gzip")
    elif encoding not in ("", "identity"):
        raise HttpError("400 Bad Request", f"unknown encoding: {encoding}")
    if len(body) > MAX_WRITE:
        raise HttpError("413 Payload Too Large", f"a write holds at most {MAX_WRITE} bytes")
    try:
        return body.decode()
    except UnicodeDecodeError as problem:
        raise HttpError("400 Bad Request", f"not UTF-8: {problem}") from problem


def write(engine: Engine, org: str, bucket: str, body: bytes, encoding: str = "identity") -> int:
    """One write request; the number of rows."""
    name = database_name(org, bucket)
    if name not in engine.databases:
        raise HttpError("404 Not Found", f"no database {name}")
    text = body_text(body, encoding)
    try:
        return engine.write_lines(name, text) if text.strip() else 0
    except (WriteError, SchemaError) as problem:
        raise HttpError("400 Bad Request", str(problem)) from problem


def query(engine: Engine, db: str, text: str, format: str = "pretty") -> str:  # noqa: A002
    if db not in engine.databases:
        raise HttpError("404 Not Found", f"no database {db}")
    if format not in _TYPES:
        raise HttpError("400 Bad Request", f"unknown format: {format}")
    try:
        return render(engine.sql(db, text), format)
    except (PySparkException, ValueError) as problem:
        raise HttpError("400 Bad Request", str(problem).splitlines()[0]) from problem


def application(engine: Engine) -> Callable[[dict, Callable], Iterable[bytes]]:
    """A WSGI application: ``POST /api/v2/write?org=&bucket=``, ``GET /api/v1/databases/<name>/query?q=&format=``,
    ``GET /api/v1/partitions?db_name=`` and ``GET /health``."""

    def answer(environ: dict) -> tuple[str, str, str]:
        method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "")
        given = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        need = lambda name: given[name] if given.get(name) else _missing(name)
        if method == "POST" and path == "/api/v2/write":
            size = int(environ.get("CONTENT_LENGTH") or 0)
            if size > MAX_WRITE:
                raise HttpError("413 Payload Too Large", f"a write holds at most {MAX_WRITE} bytes")
            write(engine, need("org"), need("bucket"), environ["wsgi.input"].read(size), environ.get("HTTP_CONTENT_ENCODING", "identity"))
            return "204 No Content", "text/plain", ""
        parts = path.strip("/").split("/")
        if method == "GET" and parts[:3] == ["api", "v1", "databases"] and len(parts) == 5 and parts[4] == "query":
            kind = given.get("format", "pretty")
            return "200 OK", _TYPES.get(kind, "text/plain"), query(engine, unquote(parts[3]), need("q"), kind)
        if method == "GET" and path == "/api/v1/partitions":
            db = engine.databases.get(need("db_name"))
            if db is None:
                raise HttpError("404 Not Found", f"no database {given['db_name']}")
            return "200 OK", "application/json", json.dumps(sorted({p for _, p in db.partitions()}))
        if method == "GET" and path == "/health":
            return "200 OK", "text/plain", "OK"
        raise HttpError("404 Not Found", f"no such route: {method} {path}")

    def run(environ: dict, start: Callable) -> Iterable[bytes]:
        try:
            status, kind, text = answer(environ)
        except HttpError as problem:
            status, kind, text = problem.status, "application/json", json.dumps({"error": str(problem)})
        data = text.encode()
        start(status, [("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(data)))])
        return [data]

    return run


def _missing(name: str) -> str:
    raise HttpError("400 Bad Request", f"{name} is needed")


def ticket_stream(engine: Engine, ticket: bytes) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    """The result that a ticket (JSON with ``database_name`` and ``sql_query``) asks for: its schema, and its batches as
    they are fetched."""
    try:
        asked = json.loads(ticket)
        name, text = asked["database_name"], asked["sql_query"]
    except (ValueError, KeyError, TypeError) as problem:
        raise ValueError(f"not a ticket: {problem!r}") from problem
    if name not in engine.databases:
        raise KeyError(f"no database {name}")
    df = engine.sql(name, text)
    schema = df.limit(0).toArrow().schema

    def batches() -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return schema, batches()


def flight_server(engine: Engine, location: str = "grpc://127.0.0.1:0"):  # noqa: ANN201
    """An Arrow Flight server that answers DoGet; other calls are not offered."""
    from pyarrow import flight

    class Server(flight.FlightServerBase):
        def do_get(self, context, ticket):  # noqa: ANN001, ANN202
            try:
                schema, batches = ticket_stream(engine, ticket.ticket)
            except (ValueError, KeyError, PySparkException) as problem:
                raise flight.FlightServerError(str(problem)) from problem
            return flight.GeneratorStream(schema, batches)

    return Server(location)
