"""Requests on the known inputs, in every layout of the same rows: one write, many writes, merged, persisted, mixed."""

import json
import random

import pytest

from tidemark.engine import Engine
from tidemark.functions.windows import Span
from tidemark.operators import dedup, pivot
from tidemark.plans import requests as R
from tidemark.plans import series as S
from tidemark.plans.predicate import Compare, Literal, Logical, Predicate, Ref
from tidemark.plans.schema import SchemaError, TsTable

# Rows of known requests, in write order.
DUPLICATES = """
h2o,state=MA,city=Boston min_temp=70.4 50
h2o,state=MA,city=Bedford min_temp=71.59 150
h2o,state=MA,city=Boston max_temp=75.4 250
h2o,state=MA,city=Andover max_temp=69.2, 250
h2o,state=MA,city=Bedford max_temp=78.75,area=742u 150
h2o,state=MA,city=Boston min_temp=65.4 250
h2o,state=MA,city=Reading min_temp=53.4, 250
h2o,state=CA,city=SF min_temp=79.0,max_temp=87.2,area=500u 300
h2o,state=CA,city=SJ min_temp=78.5,max_temp=88.0 300
h2o,state=CA,city=SJ min_temp=75.5,max_temp=84.08 350
h2o,state=MA,city=Bedford max_temp=80.75,area=742u 400
h2o,state=MA,city=Boston min_temp=68.4 400
h2o,state=MA,city=Bedford min_temp=65.22,area=750u 400
h2o,state=MA,city=Boston min_temp=65.40,max_temp=82.67 400
h2o,state=CA,city=SJ min_temp=77.0,max_temp=90.7 450
h2o,state=CA,city=SJ min_temp=69.5,max_temp=88.2 500
h2o,state=MA,city=Bedford max_temp=88.75,area=742u 600
h2o,state=MA,city=Boston min_temp=67.4 600
h2o,state=MA,city=Reading min_temp=60.4, 600
h2o,state=CA,city=SF min_temp=68.4,max_temp=85.7,area=500u 650
h2o,state=CA,city=SJ min_temp=69.5,max_temp=89.2 650
h2o,state=CA,city=SJ min_temp=75.5,max_temp=84.08 700
""".strip().split("\n")
GROUPS = """
h2o,state=MA,city=Boston temp=70.4,humidity=10 100
h2o,state=MA,city=Boston temp=72.4,humidity=20 250
h2o,state=MA,city=Cambridge temp=80 100
h2o,state=CA,city=LA temp=90.0 200
""".strip().split("\n")
SELECT = """
h2o,state=MA,city=Cambridge f=8.0,i=8i,b=true,s="d" 1000
h2o,state=MA,city=Cambridge f=7.0,i=7i,b=true,s="c" 2000
h2o,state=MA,city=Cambridge f=6.0,i=6i,b=false,s="b" 3000
h2o,state=MA,city=Cambridge f=5.0,i=5i,b=false,s="a" 4000
""".strip().split("\n")
LAYOUTS = ("one", "two", "lines", "merged", "persisted", "mixed")


def build(spark, lines, layout):
    db = Engine(spark).create_database("d")
    step = {"one": len(lines), "merged": 3, "persisted": 4, "mixed": 5, "two": len(lines) // 2 + 1, "lines": max(1, len(lines) // 6)}[layout]
    for at in range(0, len(lines), step):
        db.write_lines("\n".join(lines[at : at + step]))
        if layout in ("merged", "persisted", "mixed"):
            for address in db.partitions():
                db.rollover(*address)
    for address in db.partitions():
        chunks = [c for c in db.chunks if c.address == address]
        if layout == "merged":
            db.compact(chunks)
        elif layout == "persisted":
            db.persist(chunks)
        elif layout == "mixed":
            db.persist(chunks[:1], 300)
            left = [c for c in db.chunks if c.address == address and c.storage != "ObjectStoreOnly"]
            if len(left) > 1:
                db.compact(left[:2])
    return db


@pytest.mark.parametrize("layout", LAYOUTS)
def test_rewritten_points(spark, layout):
    rows = {(r.state, r.city, r.time): (r.min_temp, r.max_temp, None if r.area is None else int(r.area)) for r in build(spark, DUPLICATES, layout).table("h2o").df.collect()}
    assert len(rows) == 18
    assert rows["MA", "Boston", 250] == (65.4, 75.4, None)
    assert rows["MA", "Bedford", 400] == (65.22, 80.75, 750)
    assert rows["MA", "Boston", 400] == (65.4, 82.67, None)
    assert rows["MA", "Bedford", 150] == (71.59, 78.75, 742)


@pytest.mark.parametrize("layout", ["one", "two", "merged"])
def test_groups(spark, layout):
    t = build(spark, GROUPS, layout).table("h2o")
    p = Predicate().range(100, 1000).where(Logical("or", (Compare("=", Ref("city"), Literal("Boston")), Compare("=", Ref("city"), Literal("Cambridge")))))
    get = lambda kind: {r.city: r.asDict() for r in R.read_group(t, p, kind, ["state"]).collect()}
    total = get("sum")
    assert (total["Boston"]["temp"], total["Boston"]["humidity"], total["Boston"]["time"]) == (142.8, 30.0, 250)
    assert (total["Cambridge"]["temp"], total["Cambridge"]["humidity"], total["Cambridge"]["time"]) == (80.0, None, 100)
    assert get("count")["Cambridge"]["humidity"] == 0 and get("count")["Boston"]["temp"] == 2
    assert get("mean")["Boston"]["temp"] == pytest.approx(71.4)
    with pytest.raises(R.RequestError):
        R.read_group(t, p, "median")
    none = R.read_group(t, Predicate(), None, ["city"])
    assert none.columns == ["city", "state", "humidity", "temp", "time"]
    assert [r.city for r in none.collect()] == ["Boston", "Boston", "Cambridge", "LA"]


@pytest.mark.parametrize(("kind", "span", "want"), [
    ("first", (1001, 4001), {"b": (True, 2000), "f": (7.0, 2000), "i": (7, 2000), "s": ("c", 2000)}),
    ("last", (100, 3999), {"b": (False, 3000), "f": (6.0, 3000), "i": (6, 3000), "s": ("b", 3000)}),
    ("min", (100, 3999), {"b": (False, 3000), "f": (6.0, 3000), "i": (6, 3000), "s": ("b", 3000)}),
    ("max", (1001, 4001), {"b": (True, 2000), "f": (7.0, 2000), "i": (7, 2000), "s": ("c", 2000)}),
])
def test_selectors(spark, kind, span, want):
    row = R.read_group(build(spark, SELECT, "two").table("h2o"), Predicate().range(*span), kind).first()
    assert {f: (row[f], row[f"time_{f}"]) for f in "bfis"} == want


def test_selectors_with_nulls_and_ties(spark):
    rows = [("a", 5.0, 1), ("a", None, 0), ("a", 5.0, 2), ("a", 3.0, 4), ("a", 3.0, 3), ("a", None, 9)]
    t = TsTable.of(spark.createDataFrame(rows, "t string, v double, time bigint"), ["t"])
    get = lambda kind: tuple(R.read_group(t, Predicate(), kind).first())[1:]
    assert get("first") == (None, 0) and get("last") == (None, 9)
    assert get("max") == (5.0, 1) and get("min") == (3.0, 3)


def test_windows_and_refused_aggregates(spark):
    lines = [f"h2o,state=MA,city=Boston temp={v} {t}" for v, t in ((70.0, 100), (71.0, 200), (72.0, 300), (73.0, 400))] + ["h2o,state=CA,city=LA temp=90.0 100"]
    t = build(spark, lines, "two").table("h2o")
    rows = R.read_window_aggregate(t, Predicate().range(100, 450), "mean", Span(ns=200)).collect()
    assert [(r.city, r.time, r.temp) for r in rows] == [("Boston", 200, 70.0), ("Boston", 400, 71.5), ("Boston", 600, 73.0), ("LA", 200, 90.0)] or [(r.city, r.time, r.temp) for r in rows] == [("LA", 200, 90.0)] + [("Boston", 200, 70.0), ("Boston", 400, 71.5), ("Boston", 600, 73.0)]
    for kind in ("first", "last", "none"):
        with pytest.raises(R.RequestError):
            R.read_window_aggregate(t, Predicate(), kind, 200)
    with pytest.raises(R.RequestError):
        R.group_columns(t, ["temp"], [("temp", "sum")])
    assert R.read_window_aggregate(t, Predicate().field_columns("none"), "sum", 200).columns == ["city", "state", "time"]


def test_metadata(spark):
    lines = ["h2o,state=MA,city=Boston temp=70.4 100", "h2o,state=MA,county=Essex temp=70.4,moisture=1 250", "o2,city=Boston reading=5i 100"]
    db = R.Database(spark, build(spark, lines, "lines").tables())
    names = lambda df: [r[0] for r in df.collect()]
    assert names(db.measurement_names()) == ["h2o", "o2"]
    assert names(db.measurement_names(Predicate().range(200, 300))) == ["h2o"]
    assert names(db.tag_keys()) == ["city", "county", "state"]
    assert names(db.tag_keys(Predicate().range(200, 300))) == ["county", "state"]
    assert names(db.tag_values("city")) == ["Boston"]
    assert [tuple(r) for r in db.field_columns(Predicate().table("h2o")).collect()] == [("moisture", "float", 250), ("temp", "float", 250)]
    assert names(db.tag_values("_field")) == ["moisture", "reading", "temp"]
    assert db.series_cardinality().first()[0] == 3
    with pytest.raises(R.RequestError):
        db.tag_values("temp")
    with pytest.raises(R.RequestError):
        db.tag_values("_measurement", Predicate().where(Compare("=", Ref("city"), Literal("x"))))
    clash = R.Database(spark, build(spark, ["a v=1 1", "b v=1i 1"], "one").tables())
    with pytest.raises(SchemaError):
        clash.field_columns()
    assert R.Database(spark).tag_keys().count() == 0


def test_deduplication_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 5), rng.choice([None, 1.0, 2.0]), rng.choice([None, "x", "y"]), i) for i in range(300)]
    want = {}
    for tag, time, v, s, _ in rows:
        held = want.setdefault((tag, time), [None, None])
        held[0] = held[0] if v is None else v
        held[1] = held[1] if s is None else s
    t = TsTable.of(spark.createDataFrame(rows, "t string, time bigint, v double, s string, _seq bigint").repartition(3), ["t"])
    assert {(r.t, r.time): [r.v, r.s] for r in dedup.dedup_last_non_null(t).df.collect()} == want
    counts = dedup.duplicate_count(t).first()
    assert (counts["rows"], counts["removed"]) == (300, 300 - len(want))
    half = [TsTable(t.df.filter(c), t.schema) for c in ("time < 3", "time >= 3 and _seq < 150", "time >= 3 and _seq >= 150")]
    bounds = dedup.key_bounds(half)
    assert dedup.overlap_groups(bounds) == [[0], [1, 2]]
    assert {(r.t, r.time): [r.v, r.s] for r in dedup.scan(half, bounds).df.collect()} == want


def test_overlap_groups_that_a_chunk_bridges():
    assert dedup.overlap_groups([{"time": (0, 1)}, {"time": (5, 6)}, {"time": (1, 5)}, {"time": (8, 9)}]) == [[0, 1, 2], [3]]
    assert dedup.overlap_groups([{"time": (0, 9), "t": ("a", "b")}, {"time": (0, 9), "t": ("c", "d")}]) == [[0], [1]]
    assert dedup.overlap_groups([{"time": (0, 9), "t": ("a", "b")}, {"time": (3, 4)}, {"time": None}]) == [[0, 1, 2]]


def test_pivot_and_split(spark):
    df = spark.createDataFrame([(1, None, None), (2, 2, None), (3, 2, None)], "a int, b int, c int")
    assert sorted(r[0] for r in pivot.schema_pivot(df).collect()) == ["a", "b"]
    assert pivot.schema_pivot(df, []).count() == 0 and pivot.schema_pivot(df.limit(0)).count() == 0
    low, rest = pivot.stream_split(df, df.b <= 2)
    assert sorted(r.a for r in low.collect()) == [2, 3] and [r.a for r in rest.collect()] == [1]


def test_frames(spark):
    db = build(spark, ['m,t=a f=1,i=2i,s="x",b=true 30', "m,t=a f=3 10", "m,u=z i=5i 20", "m i=6i 20"], "lines")
    t = db.table("m")
    frames = {(r.field, r.tags, r.frame_no): r for r in S.series_frames(t.df, t, "m", frame=1).collect()}
    a = json.dumps({"t": "a"}, separators=(",", ":"))
    assert frames["f", a, 0].times == [10] and frames["f", a, 0].float == [3.0] and frames["f", a, 1].float == [1.0]
    assert frames["i", a, 0].integer == [2] and frames["s", a, 0].string == ["x"] and frames["b", a, 0].boolean == [True]
    assert frames["i", "{}", 0].integer == [6] and len(frames) == 7
    split = S.series_split(t.df, t).collect()
    assert sorted((r.series, r.time, r.series_row, r.series_start) for r in split) == [('{"t":"a"}', 10, 0, True), ('{"t":"a"}', 30, 1, False), ('{"u":"z"}', 20, 0, True), ("{}", 20, 0, True)]
    groups = S.group_frames(t.df, t, ["u"]).collect()
    assert [(r.partition_key_vals, r.group_start) for r in groups] == [([""], True), ([""], False), (["z"], True)] and groups[0].tag_keys == ["u", "t"]
    unsigned = build(spark, ["m v=1u 1"], "one").table("m")
    with pytest.raises(R.RequestError):
        S.series_frames(unsigned.df, unsigned, "m")
    nothing = R.read_filter(t, Predicate().field_columns("none"))
    assert S.series_frames(nothing, t, "m").count() == 0


def test_order_of_filtered_rows(spark):
    lines = ["m,a=2 v=1 5", "m,a=1,b=x v=1 9", "m v=1 7", "m,a=1 v=1 3", "m,a=1,b=x v=1 2"]
    t = build(spark, lines, "lines").table("m")
    rows = [(r.a, r.b, r.time) for r in R.read_filter(t, Predicate()).collect()]
    assert rows == [(None, None, 7), ("1", None, 3), ("1", "x", 2), ("1", "x", 9), ("2", None, 5)]
    assert R.read_filter(t, Predicate()).columns == ["a", "b", "v", "time"]
