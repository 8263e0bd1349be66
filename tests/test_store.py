"""Databases: writes and their refusal, jobs, the log and its recovery, pruning, system tables, SQL, streams."""

import json

import pytest

from tidemark.engine import Engine, Repl, render
from tidemark.functions.partitioning import TimePart
from tidemark.lifecycle import policy
from tidemark.lifecycle.windows import PersistenceWindows, checkpoint, database_checkpoint
from tidemark.plans.predicate import Compare, Literal, Logical, Predicate, Ref
from tidemark.plans.schema import SchemaError
from tidemark.sources import system_tables
from tidemark.store import log, statistics
from tidemark.store.database import Rules, WriteError
from tidemark.streaming import ingest

DAY = [TimePart("%Y-%m-%d")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


@pytest.fixture
def db(spark):
    return Engine(spark).create_database("d", Rules(partition_template=DAY))


def test_writes_that_are_refused_leave_nothing(spark, db):
    assert db.write_lines("m v=1 1") == 1
    for bad, problem in (("m v=1 2\nm v=", WriteError), ("m v=1i 2", SchemaError), ("m,v=1 w=2 2", SchemaError), ("n a=1 1\nn a=1i 2", SchemaError), ("m _seq=1 2", WriteError)):
        with pytest.raises(problem):
            db.write_lines(bad)
    with pytest.raises(WriteError, match="line 2: .*line 10") as caught:
        db.write_lines("\n".join(["m v=1"] + ["m v="] * 20))
    assert str(caught.value).count("line ") == 10
    assert rows(db.table("m").shown()) == [(1, 1.0)] and list(db.schemas) == ["m"]
    assert db.write_lines("# only a comment\n\n") == 0
    with pytest.raises(SchemaError):
        db.table("none")


def test_limits(spark):
    engine = Engine(spark)
    with pytest.raises(WriteError):
        engine.create_database("a", Rules(immutable=True)).write_lines("m v=1 1")
    small = engine.create_database("b", Rules(buffer_size_hard=1))
    small.write_lines("m v=1 1")
    with pytest.raises(WriteError):
        small.write_lines("m v=2 2")
    for bad in ("", "../x", "a b"):
        with pytest.raises(ValueError):
            engine.create_database(bad)
    with pytest.raises(ValueError):
        engine.create_database("a")


def test_lines_without_time_take_the_default(spark, db):
    db.write_lines("m v=1", default_time=55)
    db.write_lines(spark.createDataFrame([("m v=2 7",), ("m v=3 8\nm v=4 9",)], "line string"))
    assert rows(db.table("m").shown()) == [(7, 2.0), (8, 3.0), (9, 4.0), (55, 1.0)]


def test_the_last_line_of_a_write_wins(spark, db):
    db.write_lines("m v=1,w=1i 1\nm v=2 1\nm v=3 1")
    assert rows(db.table("m").shown()) == [(1, 3.0, 1)]


def test_chunks_roll_over_and_jobs(spark):
    db = Engine(spark).create_database("d", Rules(partition_template=DAY, open_row_threshold=2))
    db.write_lines("m,t=a v=1 1\nm,t=b v=2 2")
    db.write_lines("m,t=a v=3 1")
    assert [(c.id, c.storage, c.rows) for c in db.chunks] == [(0, "ClosedMutableBuffer", 2), (1, "OpenMutableBuffer", 1)]
    merged = db.compact(list(db.chunks))
    assert (merged.id, merged.storage, merged.rows, merged.clean, merged.sort_key) == (2, "ReadBuffer", 2, True, ["t", "time"])
    stored = db.write_to_store(merged)
    assert stored.storage == "ReadBufferAndObjectStore" and len(db.log.chunks) == 1
    assert rows(db.table("m").shown()) == [("a", 1, 3.0), ("b", 2, 2.0)]
    db.unload(stored)
    assert stored.storage == "ObjectStoreOnly" and rows(db.table("m").shown()) == [("a", 1, 3.0), ("b", 2, 2.0)]
    for bad in (lambda: db.unload(stored), lambda: db.compact([stored]), lambda: db.compact([]), lambda: db.write_to_store(stored), lambda: db.chunk("m", "x", 0)):
        with pytest.raises((ValueError, KeyError)):
            bad()
    db.drop(stored)
    assert db.chunks == [] and db.log.chunks == {} and db.table("m").df.count() == 0
    assert db.storage.names("data") in ([], [n for n in db.storage.names("data") if n.endswith(".json")])


def test_failed_jobs_free_their_chunks_later(spark, monkeypatch):
    clock = [100.0]
    db = Engine(spark).create_database("d", Rules(partition_template=DAY, open_linger=0), now=lambda: clock[0])
    db.write_lines("m v=1 1")
    chunk = db.rollover("m", "1970-01-01")
    monkeypatch.setattr(db, "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        db.compact([chunk])
    monkeypatch.undo()
    with pytest.raises(RuntimeError):
        db.drop(chunk)
    assert db.operations[0].status == "Failed" and policy.maintain(db)["compacted"] == 0
    clock[0] += policy.BACKOFF
    assert policy.maintain(db) == {"cleared": 1, "persisted": 0, "compacted": 1, "unloaded": 0, "dropped": 0}
    assert rows(db.table("m").shown()) == [(1, 1.0)]


def test_restart_rebuild_and_clean(spark, monkeypatch):
    monkeypatch.setattr(log, "CHECKPOINT_EVERY", 2)
    engine = Engine(spark)
    db = engine.create_database("d", Rules(partition_template=DAY))
    for k in range(5):
        db.write_lines(f"m v={k} {k}")
        db.persist([db.rollover("m", "1970-01-01")])
    want = [(k, float(k)) for k in range(5)]
    names = db.storage.names("log")
    assert sum(n.endswith(".checkpoint") for n in names) == 2 and db.log.revision == 5
    again = Engine(spark, engine.root)
    assert again.restore() == ["d"] and rows(again.databases["d"].table("m").shown()) == want
    assert again.databases["d"].log.revision == 5
    # A later write is newer than all that was persisted.
    again.databases["d"].rules = Rules(partition_template=DAY)
    again.write_lines("d", "m v=9 0")
    assert rows(again.databases["d"].table("m").shown())[0] == (0, 9.0)
    assert db.log.orphans() == []
    db.storage.create("data/lost/part-0", "x")
    assert db.log.clean() == 1 and db.log.orphans() == []
    for n in db.storage.names("log"):
        db.storage.delete(f"log/{n}")
    rebuilt = log.TransactionLog.rebuild(db.storage)
    assert rebuilt.chunks.keys() == db.log.chunks.keys() and log.TransactionLog.load(db.storage).chunks.keys() == db.log.chunks.keys()


def test_broken_logs(spark, db):
    db.log.commit()
    other = log.TransactionLog.load(db.storage)
    db.log.commit()
    with pytest.raises(FileExistsError):
        other.commit()
    assert other.revision == 1
    with pytest.raises(log.BrokenLog):
        db.log.commit(remove=["unknown"])
    db.storage.delete("log/00000000000000000001.json")
    with pytest.raises(log.BrokenLog):
        log.TransactionLog.load(db.storage)


STATS = {"t": {"count": 10, "min": "b", "max": "f"}, "v": {"count": 9, "min": 1.0, "max": 5.0}, "time": {"count": 10, "min": 100, "max": 200}, "n": {"count": 0, "min": None, "max": None}}


@pytest.mark.parametrize(("node", "want"), [
    (Compare("=", Ref("t"), Literal("a")), "none"), (Compare("=", Ref("t"), Literal("b")), "some"), (Compare("=", Ref("t"), Literal("c")), "unknown"), (Compare("!=", Ref("t"), Literal("c")), "some"),
    (Compare("<", Ref("t"), Literal("b")), "none"), (Compare("<=", Ref("t"), Literal("b")), "some"), (Compare(">", Ref("t"), Literal("f")), "none"), (Compare(">=", Literal("b"), Ref("t")), "some"),
    (Compare(">", Ref("v"), Literal(5.0)), "unknown"), (Compare(">", Ref("v"), Literal(4.0)), "some"), (Compare("=", Ref("n"), Literal(1)), "none"), (Compare("=", Ref("missing"), Literal(1)), "none"),
    (Compare("=~", Ref("t"), Literal("x")), "unknown"), (Compare("=", Ref("t"), Literal(1)), "unknown"),
    (Logical("or", (Compare("=", Ref("t"), Literal("a")), Compare("=", Ref("t"), Literal("z")))), "none"), (Logical("and", (Compare("=", Ref("t"), Literal("b")), Compare("=", Ref("t"), Literal("a")))), "none"),
])
def test_statistics_decide_or_not(node, want):
    assert statistics.match(node, STATS, 10) == want


def test_predicates_over_statistics():
    match = lambda p: statistics.predicate_match(p, STATS, 10)
    assert match(Predicate()) == "some" and match(Predicate().range(0, 100)) == "none" and match(Predicate().range(0, 101)) == "some" and match(Predicate().range(120, 130)) == "unknown"
    assert match(Predicate().range(0, 500).where(Compare("=", Ref("t"), Literal("b")))) == "unknown"
    assert statistics.predicate_match(Predicate(), STATS, 0) == "none"


def test_pruning_never_brings_back_what_was_overwritten(spark, db):
    db.write_lines("m,t=a v=100 1")
    db.rollover("m", "1970-01-01")
    db.write_lines("m,t=a v=1 1\nm,t=z v=1 86400000000000")
    p = Predicate().where(Compare(">", Ref("v"), Literal(50)))
    assert len(db.candidates("m", p)) == 3 and p.apply(db.table("m", p)).count() == 0
    key = Predicate().where(Compare("=", Ref("t"), Literal("a")))
    assert len(db.candidates("m", key)) == 2 and len(db.candidates("m", Predicate().range(5, 10))) == 0
    assert len(db.candidates("m", Predicate(partition_key="1970-01-02"))) == 1
    assert db.table("m", Predicate().range(5, 10)).df.count() == 0


def test_clean_chunks_apart_are_read_plainly(spark, db):
    for at in (1, 86_400_000_000_000):
        db.write_lines(f"m v=1 {at}")
    for address in db.partitions():
        db.move(db.rollover(*address))
    assert "Aggregate" not in db.table("m").df._jdf.queryExecution().optimizedPlan().toString()
    db.write_lines("m v=2 1")
    assert rows(db.table("m").shown()) == [(1, 2.0), (86_400_000_000_000, 1.0)]


def test_persisting_by_rows_and_age(spark):
    clock = [0.0]
    db = Engine(spark).create_database("d", Rules(partition_template=DAY, persist_row_threshold=3, late_arrive_window=60), now=lambda: clock[0])
    db.write_lines("m v=1 1\nm v=2 2\nm v=3 3")
    assert policy.maintain(db)["persisted"] == 0  # late rows may still arrive
    clock[0] = 61
    db.write_lines("m v=9 2\nm v=4 10")
    assert policy.maintain(db)["persisted"] == 1
    assert sorted((c.storage, c.rows) for c in db.chunks) == [("ObjectStoreOnly", 3), ("ReadBuffer", 1)]
    assert rows(db.table("m").shown()) == [(1, 1.0), (2, 9.0), (3, 3.0), (10, 4.0)]
    clock[0] = 61 + 1_800
    assert policy.maintain(db)["persisted"] == 1 and {c.storage for c in db.chunks} == {"ObjectStoreOnly"}


def test_memory_is_freed(spark):
    db = Engine(spark).create_database("d", Rules(partition_template=DAY, buffer_size_soft=1, drop_non_persisted=True))
    db.write_lines("m v=1 1\nm v=2 86400000000000")
    for address in db.partitions():
        db.rollover(*address)
    first, second = (db.move(c) for c in list(db.chunks))
    db.write_to_store(first)
    assert policy.free_memory(db) == {"unloaded": 1, "dropped": 1}
    assert [c.storage for c in db.chunks] == ["ObjectStoreOnly"]
    db.rules = Rules()
    assert policy.free_memory(db) == {"unloaded": 0, "dropped": 0}


def test_persistence_windows():
    w = PersistenceWindows(100)
    w.add_range((1, 1), 5, 10, 20, 0)
    w.add_range((1, 2), 5, 5, 30, 10)
    assert w.open.rows == 10 and w.open.min_time == 5 and w.open.sequences == {1: (1, 2)}
    w.add_range((1, 3), 1, 25, 26, 31)
    assert len(w.closed) == 1 and w.persistable is None and w.begin_flush() is None
    w.rotate(100)
    assert w.persistable_rows == 10 and w.persistable_time == 30
    assert w.begin_flush() == 30 and w.begin_flush() is None
    w.add_range((1, 4), 7, 40, 41, 140)
    assert w.persistable_rows == 10  # held while the flush goes on
    w.end_flush()
    assert w.persistable is None and [(c.min_time, c.max_time, c.rows) for c in w.closed] == [(31, 31, 0)]
    with pytest.raises(RuntimeError):
        w.end_flush()
    with pytest.raises(ValueError):
        w.add_range((1, 4), 1, 1, 1, 141)
    assert PersistenceWindows(5).close_after == 5 and w.close_after == 30


def test_failed_flushes_keep_their_window():
    w = PersistenceWindows(10)
    w.add_range(None, 5, 10, 20, 0)
    w.rotate(30)
    w.begin_flush()
    w.end_flush(done=False)
    assert w.persistable_rows == 5


def test_checkpoints():
    w = PersistenceWindows(100)
    w.add_range((1, 1), 5, 10, 20, 0)
    w.add_range((2, 8), 5, 10, 25, 1)
    w.add_range((1, 5), 1, 30, 40, 40)
    w.rotate(101)
    held = checkpoint("m", "p", w)
    assert held.sequences == {1: (5, 5), 2: (None, 8)} and held.least_time == 26
    other = PersistenceWindows(100)
    other.add_range((1, 2), 1, 1, 2, 0)
    assert database_checkpoint([held, checkpoint("m", "q", other)]) == {1: (2, 5), 2: (None, 8)}


def test_system_tables_and_sql(spark, db):
    engine = Engine(spark)
    engine.databases["d"] = db
    db.write_lines('m,t=a v=1,s="x, \\"y" 1\nn b=true 2')
    db.compact([db.rollover("m", "1970-01-01")])
    assert engine.system("d", "chunks").columns == [c.split()[0] for c in system_tables.CHUNKS.split(", ")]
    stats = engine.sql("d", "SELECT column_name, row_count, min_value FROM system.chunk_columns WHERE table_name = 'm'")
    assert rows(stats) == [("s", 1, 'x, "y'), ("t", 1, "a"), ("time", 1, "1"), ("v", 1, "1.0")]
    assert engine.sql("d", "SELECT * FROM m", "json") == json.dumps([{"s": 'x, "y', "t": "a", "time": 1, "v": 1.0}], separators=(",", ":"))
    assert engine.sql("d", "SELECT s, t FROM public.default.m;", "csv") == 's,t\n"x, ""y",a\n'
    assert "| true | 2    |" in engine.sql("d", "SELECT * FROM n", "pretty")
    assert rows(engine.sql("d", "SELECT 'system.chunks' AS x")) == [("system.chunks",)]
    assert "Parsed Logical Plan" in engine.sql("d", "EXPLAIN VERBOSE SELECT * FROM m").first()[0]
    assert rows(engine.sql("d", "SELECT table_name FROM information_schema.tables WHERE table_schema = 'default'")) == [("m",), ("n",)]
    assert rows(engine.observe("operations").select("database_name", "status", "description")) == [("d", "Complete", "Compacting")]
    with pytest.raises(ValueError):
        engine.sql("d", "SHOW COLUMNS FROM none")
    with pytest.raises(ValueError):
        render(spark.range(1), "xml")
    assert rows(engine.requests("d").measurement_names()) == [("m",), ("n",)]


def test_client(spark, db):
    engine = Engine(spark)
    engine.databases["d"] = db
    db.write_lines("m v=1 1")
    client = Repl(engine)
    assert client.run("SELECT 1") == "no database in use" and client.run("use nothing") == "no database nothing"
    assert client.run("show databases;") == '["d"]' and client.run("USE DATABASE d") == "using d"
    assert client.run("set format csv") == "format is csv" and client.run("set format x") == "unknown format: x"
    assert client.run("select v from m") == "v\n1.0\n" and client.run("select nothing from m").startswith("error: ")
    assert "chunks" in client.run("observer") and client.run("SELECT database_name, table_name FROM chunks") == "database_name,table_name\nd,m\n"
    assert client.run("") == "" and "USE" in client.run("help") and client.run("quit") is None


def test_streams_write_once_and_set_bad_lines_aside(spark, tmp_path):
    folder, rejected = tmp_path / "in", str(tmp_path / "rejected")
    folder.mkdir()
    (folder / "1.lp").write_text("m v=1 1\nm v=\n")
    db = Engine(spark).create_database("d", Rules(partition_template=DAY))
    run = lambda: ingest.ingest(ingest.lines_from_folder(spark, str(folder), 1), db, str(tmp_path / "cp"), rejected).awaitTermination()
    run()
    (folder / "2.lp").write_text("m v=2 1\nm v=3 3\n")
    run()
    run()
    assert rows(db.table("m").shown()) == [(1, 2.0), (3, 3.0)]
    assert [(r.line_no, r.body) for r in spark.read.parquet(rejected).collect()] == [(2, "m v=")]
    batch = spark.createDataFrame([("m v=2 1\nm v=3 3\n",)], "value string")
    ingest.write_batch(db)(batch, 1)  # run again after a failure
    assert rows(db.table("m").shown()) == [(1, 2.0), (3, 3.0)]


def test_merged_chunks_are_sorted_with_nulls_last(spark, db):
    db.write_lines("m,a=2,b=x v=1 5\nm,a=1,b=x v=1 9\nm,b=x v=1 1\nm,a=1,b=x v=1 3\nm,a=1 v=1 4\nm,a=1,b=y v=1 2\nm,a=3,b=x v=1 1")
    made = db.compact([db.rollover("m", "1970-01-01")])
    assert made.sort_key == ["b", "a", "time"]
    files = sorted(n for n in db.storage.names(db.storage.relative(made.parts[0])) if n.endswith(".parquet"))
    held = [tuple(r) for f in files for r in spark.read.parquet(f"{made.parts[0]}/{f}").select("b", "a", "time").collect()]
    assert held == [("x", "1", 3), ("x", "1", 9), ("x", "2", 5), ("x", "3", 1), ("x", None, 1), ("y", "1", 2), (None, "1", 4)]
