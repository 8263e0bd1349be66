"""Hot keys, regular grids and small files against brute force, with the defined cases."""

import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tidemark.operators import hot_keys, regular_grid, small_files
from tidemark.session import cut_lineage


def test_key_totals_against_plain_python(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None, "b" * rng.randint(1, 40)]), rng.randint(0, 3), rng.choice([None, rng.randint(-100, 100)]), rng.choice([None, rng.randint(-(2**62), 2**62)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, j int, time long, v long, seq long").repartition(7)
    want = {}
    for k, j, time, v, seq in rows:
        h = want.setdefault((k, j), [0, 0, 0, None, None, None, None])
        h[0] += 1
        if v is not None:
            h[1] += 1
            h[2] += v
            h[5], h[6] = float(v), seq
        if time is not None:
            h[3] = time if h[3] is None else min(h[3], time)
            h[4] = time if h[4] is None else max(h[4], time)
    for blocks in (1, 5, None):
        got = {(r.k, r.j): [r.rows, r["values"], int(r.total or 0), r.time_min, r.time_max, r.last_value, r.last_order] for r in hot_keys.key_totals(df, ["k", "j"], "time", "v", "seq", blocks).collect()}
        assert got == want


def test_whole_numbers_are_summed_exactly(spark):
    df = spark.createDataFrame([("a", 0, 2**53), ("a", 0, 1), ("a", 0, 1), ("b", 0, -(2**63)), ("b", 0, -(2**63)), ("c", 0, None)], "k string, time long, v long")
    got = {r.k: r.total for r in hot_keys.key_totals(df, ["k"], value="v").collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == {"a": 2**53 + 2, "b": -(2**64), "c": None}


def test_dictionaries_that_are_sent_on_early(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "FLUSH_KEYS", 10)
    df = spark.createDataFrame([(i % 97, i, 1.0) for i in range(2000)], "k long, time long, v double")
    got = {r.k: (r.rows, r.total) for r in hot_keys.key_totals(df, ["k"], value="v").collect()}
    assert got == {k: (n, float(n)) for k, n in Counter(i % 97 for i in range(2000)).items()}


def test_heavy_keys_and_last_values(spark):
    rows = [("a", 1, 1.0, 1), ("a", 1, None, 5), ("a", 1, 2.0, 3), ("b", 1, None, 1), ("c", 1, 7.0, None), ("c", 1, 8.0, None)]
    df = spark.createDataFrame(rows, "k string, time long, value double, seq long")
    assert sorted(r.k for r in hot_keys.heavy_keys(df, ["k"], (30, 100)).collect()) == ["a", "c"]
    got = {r.k: (r.value, r.seq, r.writes) for r in hot_keys.last_values(df, ["k", "time"]).collect()}
    assert got == {"a": (2.0, 3, 3), "b": (None, None, 1), "c": (None, None, 2)}
    assert hot_keys.heavy_keys(df.limit(0), ["k"]).count() == 0 and hot_keys.last_values(df.limit(0), ["k"]).count() == 0


REQUESTS = "request_id long, db_name string, table_name string, range_start long, range_end long, window_every long, window_offset long, aggregate string"
READINGS = "seq long, db_name string, table_name string, host string, value double, time long, source string, bucket int"


def plain_grid(readings, requests, gap=4):
    found = {}
    for rid, db, tb, start, end, every, offset, kind in requests:
        if None in (start, end, every) or end <= start or every <= 0:
            continue
        offset = offset or 0
        points = defaultdict(dict)
        for seq, d, t, host, value, time in readings:
            if (d, t) == (db, tb) and host is not None and time is not None and start <= time < end:
                held = points[host].setdefault(time, (-1, None))
                if value is not None and seq > held[0]:
                    points[host][time] = (seq, value)
        first = (start - offset) // every * every + offset
        for host, by_time in points.items():
            known = sorted((t, v) for t, (_, v) in by_time.items() if v is not None)
            for w in range(first, end, every):
                inside = [v for t, v in known if w <= t < w + every]
                stop = w + every
                if inside:
                    value = {"count": float(len(inside)), "sum": sum(inside), "min": min(inside), "max": max(inside), "first": inside[0], "last": inside[-1]}.get(kind, sum(inside) / len(inside))
                    found[rid, host, stop] = ("observed", round(value, 6))
                    continue
                before, after = [p for p in known if p[0] < w], [p for p in known if p[0] >= stop]
                near = before and after and after[0][0] - before[-1][0] <= every * gap
                if kind == "count":
                    found[rid, host, stop] = ("gap", 0.0)
                elif near and kind != "sum":
                    (t0, v0), (t1, v1) = before[-1], after[0]
                    found[rid, host, stop] = ("interpolated", round(v0 + (v1 - v0) * ((stop - t0) / (t1 - t0)), 6))
                else:
                    found[rid, host, stop] = ("gap", None)
    return found


@pytest.mark.parametrize(("block", "hot", "broadcast"), [(4096, 10**6, 50_000), (3, 20, 0)])
def test_grid_against_plain_python(spark, monkeypatch, block, hot, broadcast):
    monkeypatch.setattr(regular_grid, "BLOCK", block)
    monkeypatch.setattr(regular_grid, "HOT_ROWS", hot)
    monkeypatch.setattr(regular_grid, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(regular_grid, "BUCKET", 100)
    rng = random.Random(2)
    readings = [(i, "d", rng.choice("ttu"), rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random()]), rng.choice([rng.randint(-50, 900), 77, None])) for i in range(400)]
    requests = [(1, "d", "t", 0, 700, 30, None, "mean"), (2, "d", "t", 13, 640, 50, 7, "count"), (3, "d", "u", -40, 900, 11, -3, "last"), (3, "d", "u", -40, 900, 11, -3, "last"), (4, "d", "t", 500, 500, 10, 0, "sum"),
                (5, "d", "t", 600, 10, 10, 0, "sum"), (6, None, "t", 0, 10, 10, 0, "sum"), (7, "d", "t", None, 10, 10, 0, "sum"), (8, "d", "t", 0, 100, 0, 0, "sum"), (9, "d", "t", 0, 700, 40, 0, "sum"), (10, "d", "t", 5, 650, 20, 0, "first")]
    df = spark.createDataFrame([(*r, "x", 0) for r in readings], READINGS).repartition(3)
    grid = regular_grid.regular_grid(df, spark.createDataFrame(list(dict.fromkeys(requests)), REQUESTS)).collect()
    got = {(r.request_id, r.host, r.window_stop): (r.state, None if r.value is None else round(r.value, 6)) for r in grid}
    assert len(got) == len(grid) and got == plain_grid(readings, requests)


def test_grid_of_empty_tables(spark):
    readings, requests = spark.createDataFrame([], READINGS), spark.createDataFrame([], REQUESTS)
    assert regular_grid.regular_grid(readings, requests).count() == 0


FILES = "file_id long, db_name string, table_name string, partition_key string, chunk_id long, version int, creation_timestamp timestamp, file_bytes long, row_count long"


def small_case(spark, n=40, partitions=3):
    import datetime

    at = lambda i: datetime.datetime(2021, 1, 1) + datetime.timedelta(seconds=i)
    files = [(i, "d", "t", f"p{i % partitions}", i, 1, at(i), 1000 + i, 5) for i in range(n)]
    files += [(100, "d", "t", "p0", 0, 1, at(500), 10, 5), (101, "d", "t", "alone", 0, 1, at(1), None, 0), (102, "d", "t", "p0", 77, 1, at(1), 10, 5), files[5]]
    compactions = spark.createDataFrame([(1, "d", "t", "p0", [77, 999], at(1), at(2)), (2, "d", "t", "p1", [1], at(1), None), (3, "d", "t", "p2", [], at(1), at(2)), (4, "d", "t", "p2", None, at(1), at(2))],
                                        "job_id long, db_name string, table_name string, partition_key string, chunks array<long>, started_at timestamp, finished_at timestamp")
    records = spark.createDataFrame([(i, k, f"r{i}.{k}") for i in [*range(n), 100, 102] if i % 7 for k in range(5)], "file_id long, row_no int, record string")
    return spark.createDataFrame(files, FILES), compactions, records


def test_merge_publishes_every_record_once_and_again(spark, tmp_path):
    files, compactions, records = small_case(spark)
    live = small_files.live_files(files, compactions)
    ids = {r.file_id for r in live.collect()}
    assert ids == {*range(1, 40), 100, 101}
    plan = small_files.merge_plan(live).cache()
    assert {r.file_id for r in plan.collect()} == ids - {101}
    out = str(tmp_path / "out")
    assert small_files.current(spark, out) is None and small_files.clean(spark, out) == 0
    for version in (1, 2):
        manifest = cut_lineage(small_files.merge_records(plan, records, out))
        small_files.publish(manifest, plan, records, out)
        held = small_files.current(spark, out).collect()
        assert sorted(i for r in held for i in r.sources) == sorted(ids - {101})
        rows = [tuple(r.values()) for r in held if r.path for r in pq.read_table(r.path.removeprefix("file://")).to_pylist()]
        want = [(r.file_id, r.row_no, r.record) for r in records.collect() if r.file_id in ids - {101}]
        assert sorted(rows) == sorted(want)
        assert small_files.clean(spark, out) == (0 if version == 1 else 1 + len([r for r in held if r.path]))
    with pytest.raises(small_files.Unverified):
        small_files.publish(manifest, plan, records.limit(3), out)


def test_groups_without_records_are_listed(spark, tmp_path):
    files, compactions, records = small_case(spark)
    plan = small_files.merge_plan(small_files.live_files(files, compactions)).cache()
    manifest = small_files.merge_records(plan, records.limit(0), str(tmp_path)).cache()
    manifest.count()
    small_files.publish(manifest, plan, records.limit(0), str(tmp_path))
    held = small_files.current(spark, str(tmp_path)).collect()
    assert {(r.path, r.n_rows) for r in held} == {(None, 0)} and sum(len(r.sources) for r in held) == plan.count()


def test_real_files_are_compacted_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).repartition(20).write.parquet(source)
    for _ in range(2):
        small_files.compact_parquet(small_files.list_files(spark, source), out)
        held = small_files.current(spark, out).collect()
        assert len(held) == 1 and held[0].n_rows == 1000
        assert sorted(r.id for r in spark.read.parquet(held[0].path).collect()) == list(range(1000))
    assert small_files.clean(spark, out) == 2


def test_longest_first_is_balanced(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    load = Counter()
    for size, g in zip(sizes, small_files.longest_first(sizes, 7), strict=True):
        load[g] += size
    assert max(load.values()) - min(load.values()) <= 1000 and len(load) == 7
    monkeypatch.setattr(small_files, "SUBLIST", 6)
    files, compactions, _ = small_case(spark, 60, 2)
    plan = small_files.merge_plan(small_files.live_files(files, compactions)).collect()
    assert len(plan) == len({r.file_id for r in plan}) == 60
    with pytest.raises(ValueError):
        small_files.merge_plan(small_files.live_files(files, compactions), small=10, target=20)


def test_empty_tables(spark):
    files, compactions, _ = small_case(spark)
    assert small_files.merge_plan(small_files.live_files(files.limit(0), compactions)).count() == 0
    assert small_files.live_files(files, compactions.limit(0)).count() == 42
