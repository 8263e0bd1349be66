"""HTTP, Flight, the write buffer, and the data they leave."""

import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import partitioning
from tidemark.lifecycle.windows import checkpoint
from tidemark.sources import api
from tidemark.streaming.write_buffer import WriteBuffer


@pytest.fixture(scope="module")
def engine(spark):
    made = Engine(spark)
    made.create_database("my%5Forg_b")
    made.write_lines("my%5Forg_b", "m v=1 1")
    return made


def call(engine, method, path, query="", body=b"", **headers):
    seen = {}
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body), **headers}
    text = b"".join(api.application(engine)(environ, lambda status, _: seen.update(status=status))).decode()
    return int(seen["status"][:3]), text


def test_http(engine):
    assert call(engine, "GET", "/health") == (200, "OK")
    assert call(engine, "POST", "/api/v2/write", "org=my_org&bucket=b", b"m v=2 2")[0] == 204
    assert call(engine, "POST", "/api/v2/write", "org=my_org&bucket=b", gzip.compress(b"m v=3 3"), HTTP_CONTENT_ENCODING="gzip")[0] == 204
    assert call(engine, "POST", "/api/v2/write", "org=my_org&bucket=b", b"  \n")[0] == 204
    status, text = call(engine, "GET", "/api/v1/databases/my%255Forg_b/query", "q=SELECT+v+FROM+m+ORDER+BY+v&format=json")
    assert status == 200 and json.loads(text) == [{"v": 1.0}, {"v": 2.0}, {"v": 3.0}]
    assert call(engine, "GET", "/api/v1/partitions", "db_name=my%255Forg_b") == (200, '["m-1970-01-01 00:00:00"]')


@pytest.mark.parametrize(("method", "path", "query", "body", "headers", "status"), [
    ("POST", "/api/v2/write", "org=a", b"", {}, 400), ("POST", "/api/v2/write", "org=none&bucket=b", b"m v=1", {}, 404), ("POST", "/api/v2/write", "org=my_org&bucket=b", b"m v=", {}, 400),
    ("POST", "/api/v2/write", "org=my_org&bucket=b", b"m v=1i", {}, 400), ("POST", "/api/v2/write", "org=my_org&bucket=b", b"\xff", {}, 400), ("POST", "/api/v2/write", "org=my_org&bucket=b", b"x", {"HTTP_CONTENT_ENCODING": "gzip"}, 400),
    ("POST", "/api/v2/write", "org=my_org&bucket=b", b"x", {"HTTP_CONTENT_ENCODING": "br"}, 400), ("POST", "/api/v2/write", "org=my_org&bucket=b", gzip.compress(b"#" * 11_000_000), {"HTTP_CONTENT_ENCODING": "gzip"}, 413),
    ("GET", "/api/v1/databases/none/query", "q=x", b"", {}, 404), ("GET", "/api/v1/databases/my%255Forg_b/query", "q=SELEC", b"", {}, 400), ("GET", "/api/v1/databases/my%255Forg_b/query", "q=SELECT+1&format=x", b"", {}, 400),
    ("GET", "/api/v1/databases/my%255Forg_b/query", "", b"", {}, 400), ("GET", "/api/v1/partitions", "db_name=x", b"", {}, 404), ("GET", "/other", "", b"", {}, 404),
])
def test_http_refusals(engine, method, path, query, body, headers, status):
    found, text = call(engine, method, path, query, body, **headers)
    assert found == status and "error" in json.loads(text)


def test_flight(engine):
    flight = pytest.importorskip("pyarrow.flight")
    with api.flight_server(engine) as server, flight.connect(f"grpc://127.0.0.1:{server.port}") as client:
        ticket = json.dumps({"database_name": "my%5Forg_b", "sql_query": "SELECT v FROM m WHERE v < 2"}).encode()
        assert client.do_get(flight.Ticket(ticket)).read_all().to_pylist() == [{"v": 1.0}]
        for bad in (b"x", b"{}", json.dumps({"database_name": "none", "sql_query": "x"}).encode(), json.dumps({"database_name": "my%5Forg_b", "sql_query": "SELEC"}).encode()):
            with pytest.raises(flight.FlightError):
                client.do_get(flight.Ticket(bad)).read_all()


def test_write_buffer(spark, tmp_path):
    buffer = WriteBuffer(spark, str(tmp_path))
    assert [buffer.store(f"m v={k} 1") for k in range(3)] == [0, 1, 2]
    db = Engine(spark).create_database("d")
    assert buffer.replay(db) == 3 and db.table("m").df.first()["v"] == 2.0
    buffer.store("m v=9 9")
    assert buffer.replay(db, 3) == 4 and db.table("m").df.count() == 2
    windows = db.windows["m", db.chunks[0].partition_key]
    assert buffer.resume_from([checkpoint("m", "p", windows)]) == 0
    windows.rotate(db.now() + 1e6)
    assert buffer.resume_from([checkpoint("m", "p", windows)]) == 4
    assert buffer.resume_from([]) == 0


def test_routing(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") * 86_400_000_000_000).alias("time"))
    placed = partitioning.routed(df, "m", [partitioning.TablePart(), partitioning.TimePart("%Y")], ["k"], [("^x", 0)], 3)
    assert {r.shard for r in placed.select("shard").distinct().collect()} == {0, 1, 2}
    assert {r.partition_key for r in placed.collect()} == {"m-1970"}
