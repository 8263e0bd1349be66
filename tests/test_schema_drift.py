"""Records whose paths their file does not declare are part of the consistent table."""

import datetime
import json

import pytest

from tidemark.operators import schema_drift


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda n: datetime.datetime(2021, 1, n)
    files = spark.createDataFrame(
        [(1, "d", "t", 1, day(1)), (2, "d", "t", 1, day(2)), (3, "d", "t", 1, day(3)), (4, "d", "t", 1, day(4)), (4, "d", "t", 1, day(4)), (5, "d", "u", 1, day(1)), (6, "d", "t", 1, day(6))],
        "file_id long, db_name string, table_name string, version int, creation_timestamp timestamp",
    )
    # Files 2 and 6 declare nothing; file 3 renames old to new; table u declares nothing at all.
    columns = spark.createDataFrame(
        [(1, 1, "old", "F64", "Field"), (1, 2, "n", "I64", "Field"), (3, 1, "new", "F64", "Field"), (3, 2, "n", "I64", "Field"), (4, 1, "new", "F64", "Field"), (4, 2, "n", "I64", "Field")],
        "file_id long, ordinal int, column_name string, column_type string, influxdb_type string",
    )
    records = spark.createDataFrame(
        [
            (1, 1, '{"old": 1.5, "n": 1}'), (1, 2, None), (1, 3, "{}"), (1, 4, "[1]"), (1, 5, "{broken"),
            (2, 1, '{"old": 2.5, "n": "x"}'), (6, 1, '{"old": 3.5, "new": 4.5}'),
            (4, 1, '{"new": 5.5, "old": 6.5, "odd": 7, "none": null}'),
            (5, 1, '{"n": 8}'), (9, 1, '{"n": 9}'),
        ],
        "file_id long, row_no int, record string",
    )
    ordered = schema_drift.ordered_files(files, columns, "influxdb_type")
    lineages = schema_drift.lineages(ordered, schema_drift.schema_changes(ordered))
    found = schema_drift.consistent_rows(records, files, lineages).collect()
    assert len(found) == 10
    return {(r.file_id, r.row_no): (r.table_name, json.loads(r["values"]), r.failed) for r in found}


def test_files_without_declared_columns(rows):
    assert rows[1, 1] == ("t", {"new": "1.5", "n": "1"}, "")
    assert rows[2, 1] == ("t", {"new": "2.5", "n": None}, "n I64 STRING x")


def test_records_without_paths(rows):
    assert rows[1, 2] == rows[1, 3] == ("t", {}, "")
    assert rows[1, 4] == ("t", {}, "UNREADABLE [1]")
    assert rows[1, 5] == ("t", {}, "UNREADABLE {broken")


def test_one_column_never_takes_two_paths(rows):
    assert rows[6, 1] == ("t", {"new": "4.5"}, "old UNDECLARED DOUBLE 3.5")
    assert rows[4, 1] == ("t", {"new": "5.5"}, "odd UNDECLARED BIGINT 7; old UNDECLARED DOUBLE 6.5")


def test_paths_and_files_unknown_everywhere(rows):
    assert rows[5, 1] == ("u", {}, "n UNDECLARED BIGINT 8")
    assert rows[9, 1] == (None, {}, "n UNDECLARED BIGINT 9")
