"""Line protocol: what loads, what is rejected and why, by the JVM's expressions and by the source's line splitter."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import quarantine
from tidemark.sources import line_protocol

BAD = {
    "m": "no fields",
    "m ": "no fields",
    ",t=a v=1": "no measurement",
    "m,t=a,t=b v=1": "repeated tag key",
    "m,t= v=1": "malformed tag set",
    "m v=": "malformed field set",
    "m v=1,w=2,": "malformed field set",
    "m v=1ii": "malformed field set",
    "m v=9223372036854775808i": "integer out of range",
    "m v=18446744073709551616u": "unsigned out of range",
    "m v=-1u": "malformed field set",
    "m v=1e+999": "float out of range",
    "m v=1 9223372036854775808": "timestamp out of range",
    "m v=1 5 6": "trailing content",
    "m v=1 x": "trailing content",
    'm v="open': "malformed field set",
    "m v=1\t5": "trailing content",
    "m\\": "no fields",
}
GOOD = [
    "m v=1", "m v=1.5,w=2i,x=3u,y=t,z=\"a b\" 5", "  m v=1 5  ", "m,a=b,c=d v=1", 'm v="a \\"quoted\\" \\\\ text"', "m\\ x,t\\,a=b\\=c v=1", "m v=1, 250", "m v=1e+5", "m v=1.5e+3 -7", "m v=-9223372036854775808i",
    "m v=18446744073709551615u", "m v=true,w=False,x=F", 'm v="two\nlines" 9', "µ,ü=ä ö=1",
]


def report(spark, texts, claimed=None):
    rows = [(i, t, claimed[i] if claimed else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id long, lp_data string, lines_written long")
    return sorted((r.request_id, r.line_no, r.reason) for r in quarantine.load_report(df).collect())


def test_reasons(spark):
    found = report(spark, list(BAD))
    assert len(found) == len(BAD)
    for (_, line, reason), want in zip(found, BAD.values(), strict=True):
        assert line == 1 and want in reason


def test_valid_lines(spark):
    assert report(spark, GOOD) == []


def test_comments_blanks_and_requests(spark):
    text = '# note v="\nm v=1 1\n\n  \nm v=\nm v="a\nb" 2\n'
    assert report(spark, [text, text, "", None], [2, 3, 0, 5]) == [(0, 5, "malformed field set"), (1, 0, "lines_written differs"), (1, 5, "malformed field set"), (3, 0, "lines_written differs")]


def test_repeated_requests_are_judged_apart(spark):
    df = spark.createDataFrame([(7, "m v=1 1\nm v=2 2", 2)] * 2, "request_id long, lp_data string, lines_written long")
    assert quarantine.load_report(df).count() == 0


def test_typed_points(spark):
    df = spark.createDataFrame([('my\\ m,b=x\\,y,a=z f=1.5,i=-2i,u=3u,s="q\\"\\\\",t=T,f=2.5 -5\nm v=1', "extra")], "lp string, line_no string")
    valid, bad = quarantine.split_valid(quarantine.parse_lines(df, "lp"))
    from pyspark.sql import functions as F

    one, two = quarantine.typed_rows(valid, F.lit(99).cast("bigint")).orderBy("line_no").collect()
    assert bad.count() == 0
    assert one.measurement == "my m" and one.tags == {"b": "x,y", "a": "z"} and one.time == -5 and two.time == 99
    assert (one.f64, one.i64, {k: int(v) for k, v in one.u64.items()}, one.str, one.bool) == ({"f": 2.5}, {"i": -2}, {"u": 3}, {"s": 'q"\\'}, {"t": True})


def test_empty_table(spark):
    df = spark.createDataFrame([], "request_id long, lp_data string, lines_written long")
    assert quarantine.load_report(df).count() == 0


def plain_lines(text):
    """Logical lines by the grammar's words, one character after the other."""
    lines, held, at = [], "", 0
    fields = quoted = False
    while at < len(text):
        c = text[at]
        stripped = held.lstrip(" \t")
        if quoted:
            step = text[at : at + 2] if c == "\\" else c
            held += step
            at += len(step)
            quoted = c != '"'
            continue
        if c == "\n":
            lines.append(held)
            held, fields = "", False
            at += 1
            continue
        if stripped.startswith("#"):
            held += c
            at += 1
            continue
        if c == " " and stripped:
            fields = True
        if c == "\\" and text[at + 1 : at + 2] not in ("", "\n"):
            held += text[at : at + 2]
            at += 2
        elif fields and text[at : at + 2] == '="':
            held += '="'
            at += 2
            quoted = True
        else:
            held += c
            at += 1
    return [*lines, held] if held else lines


ALPHABET = st.text(st.sampled_from('m=", \\\n#1'), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(1, 7))
def test_source_splits_like_plain_python(text, block):
    blocks = (text[i : i + block] for i in range(0, len(text), block))
    assert list(line_protocol.logical_lines(blocks)) == plain_lines(text)


def test_expressions_split_like_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices('m=", \\\n#1', k=rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: [line.removesuffix("\n") for line in r.x] for r in df.select("i", quarantine.logical_lines(df.t).alias("x")).collect()}
    for i, t in enumerate(texts):
        # The expressions may end with one more blank line, which is neither valid nor invalid.
        assert found[i] in (plain_lines(t), [*plain_lines(t), ""]), repr(t)


def test_source(spark, tmp_path):
    (tmp_path / "a.lp").write_text('m v=1 1\nm v="x\ny" 2\nbad\n')
    (tmp_path / "b.lp").write_text("m v=3 3")
    (tmp_path / ".hidden").write_text("m v=4 4")
    line_protocol.register(spark)
    lines = spark.read.format("lineprotocol").load(str(tmp_path))
    points, bad = line_protocol.points(lines)
    assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.time) for r in points.collect()) == [("a.lp", 1, 1), ("a.lp", 2, 2), ("b.lp", 1, 3)]
    assert [(r.line_no, r.body) for r in bad.collect()] == [(3, "bad")]


def test_streamed_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.lp").write_text("m v=1 1\nm v=2 2\n")
    line_protocol.register(spark)
    stream = spark.readStream.format("lineprotocol").load(str(tmp_path / "in"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    query.processAllAvailable()
    (tmp_path / "in/b.lp").write_text("m v=3 3\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m v=1 1", "m v=2 2", "m v=3 3"]


@pytest.mark.parametrize("length", [10_000, 2_000_000])
def test_long_lines(spark, length):
    assert report(spark, ['m v="' + "x" * length + '" 1\nm v=', "m " + "v" * length + "=1"]) == [(0, 2, "malformed field set")]
