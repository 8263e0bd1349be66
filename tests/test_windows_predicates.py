"""Window bounds, durations, predicates and request arguments, with every refusal."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import partitioning, windows
from tidemark.functions.sqlnames import register, write_out
from tidemark.functions.windows import Span
from tidemark.plans import predicate as P
from tidemark.plans import requests as R
from tidemark.plans.predicate import Arithmetic, Compare, Literal, Logical, Predicate, Ref, UnsupportedPredicate
from tidemark.plans.schema import SchemaError, TsSchema, TsTable, union_tables


def stops(spark, times, every, offset=0):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t bigint")
    return [r.s for r in df.select("i", windows.window_stop(F.col("t"), every, offset).alias("s")).orderBy("i").collect()]


def test_windows_of_nanoseconds(spark):
    assert stops(spark, [100, None, 200, 300, 400], 200, 50) == [250, None, 250, 450, 450]
    assert stops(spark, [-1, -200, -201], 200) == [0, 0, -200]


def test_windows_match_plain_arithmetic(spark):
    rng = random.Random(1)
    for every, offset in ((7, 3), (3_600_000_000_000, -5), (10**12, 10**11)):
        times = [rng.randint(-(10**18), 10**18) for _ in range(200)]
        assert stops(spark, times, every, offset) == [(t - offset) // every * every + every + offset for t in times]


def ns(*date):
    return int(datetime.datetime(*date, tzinfo=datetime.UTC).timestamp()) * 10**9


def test_windows_of_months(spark):
    assert stops(spark, [ns(2020, 3, 1), ns(2020, 3, 2), ns(2020, 4, 1), ns(1969, 12, 31)], Span(months=1)) == [ns(2020, 4, 1), ns(2020, 4, 1), ns(2020, 5, 1), ns(1970, 1, 1)]
    assert stops(spark, [ns(2020, 5, 17)], Span(months=3)) == [ns(2020, 7, 1)]
    assert stops(spark, [ns(2020, 1, 31)], Span(months=2), Span(months=1)) == [ns(2020, 2, 1)]


def test_durations_that_are_refused(spark):
    for bad in (lambda: Span(1, 1), lambda: Span(months=-1), lambda: windows.window_stop(F.lit(1), 0), lambda: windows.window_stop(F.lit(1), 5, Span(months=1))):
        with pytest.raises(ValueError):
            bad()


def test_window_arguments():
    hour = Span(ns=3600)
    assert R.window_arguments(["sum"], hour, None, None) == ("sum", hour, Span())
    assert R.window_arguments(["sum"], None, None, (hour, Span(ns=5))) == ("sum", hour, Span(ns=5))
    assert R.window_arguments(["sum"], Span(ns=7), None, (hour, Span(ns=5))) == ("sum", Span(ns=7), Span())
    for bad in ([], ["sum", "max"]):
        with pytest.raises(R.RequestError):
            R.window_arguments(bad, hour, None, None)
    for every, window in ((None, None), (Span(), None), (None, (Span(), Span()))):
        with pytest.raises(R.RequestError):
            R.window_arguments(["sum"], every, None, window)


def test_group_arguments():
    assert R.group_arguments("by", ["a"], "none") == (["a"], None)
    assert R.group_arguments("none", [], "first") == ([], "first")
    for bad in (("none", ["a"], None), ("other", [], None), ("by", [], "median")):
        with pytest.raises(R.RequestError):
            R.group_arguments(*bad)
    assert R.reorder_prefix(["three", "one"], ["one", "two", "three"]) == ["three", "one", "two"]
    for bad in (["one", "one"], ["four"]):
        with pytest.raises(R.RequestError):
            R.reorder_prefix(bad, ["one", "two", "three"])


def series(spark):
    rows = [("a", "x", 1.0, 10), ("a", None, 2.0, 20), (None, "y", None, 30), ("b", "x", 4.0, 40)]
    return TsTable.of(spark.createDataFrame(rows, "t string, u string, v double, time bigint"), ["t", "u"], "m")


def test_predicates(spark):
    t = series(spark)
    times = lambda p: sorted(r.time for r in p.apply(t).collect())
    assert times(Predicate().range(10, 40)) == [10, 20, 30]
    assert times(Predicate().where(Compare("=~", Ref("t"), Literal("^a")))) == [10, 20]
    assert times(Predicate().where(Compare("!~", Ref("t"), Literal("^a")))) == [40]
    assert times(Predicate().where(Compare(">", Arithmetic("*", Ref("v"), Literal(2)), Literal(3)))) == [20, 40]
    assert times(Predicate().where(Logical("or", (Compare("=", Ref("t"), Literal("b")), Compare("=", Ref("u"), Literal("y")))))) == [30, 40]
    assert Predicate().where(Logical("or", (Compare("=", Ref("t"), Literal("b")), Compare("=", Ref("missing"), Literal(1))))).apply(t) is None
    assert Predicate(partition_key="p").apply(t) is None


@pytest.mark.parametrize("node", [Compare("%", Ref("v"), Literal(1)), Compare("like", Ref("t"), Literal("a%")), ("is null", Ref("t")), Arithmetic("%", Ref("v"), Literal(2)), Logical("xor", ())])
def test_constructs_that_requests_refuse(node):
    with pytest.raises(UnsupportedPredicate):
        P.to_column(node)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", r"\k<x>", "(?>a)", "a++", "a*+b", "a?+"])
def test_patterns_that_are_no_regular_language(pattern):
    with pytest.raises(UnsupportedPredicate):
        P.regex_match(F.lit("x"), pattern)


def leaf(op, name, value, kind="tag"):
    return {"type": "compare", "op": op, "children": [{"type": kind, "name": name}, {"type": "literal", "value": value}]}


def test_request_trees(spark):
    both = {"type": "logical", "op": "and", "children": [leaf("gt", "v", 1.5, "field"), {"type": "paren", "children": [leaf("equal", "t", "a")]}]}
    found = P.from_tree({"type": "root", "children": [both]})
    assert len(found.exprs) == 2 and [r.time for r in found.apply(series(spark)).collect()] == [20]
    either = {"type": "logical", "op": "or", "children": [leaf("equal", "_measurement", "m"), leaf("equal", "\x00", "n")]}
    assert P.from_tree(either).tables == {"m", "n"}
    assert P.from_tree(leaf("equal", "\xff", "v")).fields == {"v"}
    for kind, value in (("bool", True), ("int", 3), ("float", 1.5), ("text", "x")):
        assert P.from_tree(leaf("not_equal", "v", value)).exprs[0] == Compare("!=", Ref("v"), Literal(value)), kind
    for op, sign in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="), ("regex", "=~"), ("not_regex", "!~")):
        assert P.from_tree(leaf(op, "t", "a")).exprs[0].op == sign
    assert P.from_tree(None) == Predicate()


@pytest.mark.parametrize("tree", [leaf("starts_with", "t", "a"), leaf("lt", "_measurement", "m"), {"type": "logical", "op": "xor", "children": [leaf("equal", "t", "a"), leaf("equal", "t", "b")]}, {"type": "call"}])
def test_request_trees_that_are_refused(tree):
    with pytest.raises(UnsupportedPredicate):
        P.from_tree(tree)


def test_schemas_merge_strictly(spark):
    t = series(spark)
    other = TsTable.of(spark.createDataFrame([("z", 1, 5)], "w string, n bigint, time bigint"), ["w"], "m")
    merged = union_tables([t, other])
    assert merged.shown().columns == ["n", "t", "time", "u", "v", "w"] and merged.df.count() == 5
    assert t.shown().schema["t"].metadata == {"ts.role": "tag"}
    for bad in (TsSchema({"v": "integer"}), TsSchema({"t": "string"}), TsSchema({}, "other")):
        with pytest.raises(SchemaError):
            t.schema.merge(bad)
    with pytest.raises(SchemaError):
        TsTable.of(spark.createDataFrame([(1,)], "x bigint"), [])


def test_partition_keys_and_shards(spark):
    df = spark.createDataFrame([("a", ns(2021, 4, 5)), (None, ns(1969, 12, 31))], "t string, time bigint")
    parts = [partitioning.TablePart(), partitioning.ColumnPart("t"), partitioning.ColumnPart("none"), partitioning.TimePart("day %Y-%m-%d")]
    got = [r[0] for r in df.select(partitioning.partition_key(parts, "m", df.columns, F.col("time"))).collect()]
    assert got == ["m-t_a--day 2021-04-05", "m---day 1969-12-31"]
    with pytest.raises(ValueError):
        partitioning.strftime_pattern("%Q")
    with pytest.raises(ValueError):
        partitioning.partition_key(["x"], "m", [], F.col("time"))
    with pytest.raises(Exception, match="no shard"):
        df.select(partitioning.shard(F.col("t"), [], [("^z", 1)], None)).collect()
    assert {r[0] for r in df.select(partitioning.shard(F.lit("zed"), [], [("^z", 1)], None)).collect()} == {1}


@settings(max_examples=25, deadline=None)
@given(st.datetimes(datetime.datetime(1900, 1, 1), datetime.datetime(2100, 1, 1)), st.integers(0, 999_999_999), st.integers(-720, 840))
def test_texts_to_nanoseconds(spark, when, nanos, minutes):
    register(spark)
    when = when.replace(microsecond=0)
    sign, size = "-" if minutes < 0 else "+", abs(minutes)
    text = f"{when:%Y-%m-%dT%H:%M:%S}.{nanos:09d}{sign}{size // 60:02d}:{size % 60:02d}"
    want = (int(when.replace(tzinfo=datetime.UTC).timestamp()) - minutes * 60) * 10**9 + nanos
    assert spark.sql(f"SELECT to_timestamp_ns('{text}')").first()[0] == want


def test_selectors_are_written_out_outside_quotes():
    text = write_out("SELECT selector_max_time(v, t), 'selector_max_time(v, t)' FROM x -- selector_min_value(a, b)")
    assert "'selector_max_time(v, t)'" in text and "-- selector_min_value(a, b)" in text and "max(CASE WHEN (v)" in text
