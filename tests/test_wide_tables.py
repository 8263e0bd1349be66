"""The wide table holds every record of every database table as typed columns."""

import datetime
from decimal import Decimal

import __spark_entry__


def stored(spark, folder, columns, records):
    day = datetime.datetime(2021, 1, 1)
    files = [(1, "d", "a", 1, day), (2, "d", "b", 1, day), (3, "e", "a", 1, day), (4, "e", "c", 1, day)]
    spark.createDataFrame(files, "file_id long, db_name string, table_name string, version int, creation_timestamp timestamp").write.parquet(f"{folder}/parquet_files.parquet")
    spark.createDataFrame(columns, "file_id long, ordinal int, column_name string, column_type string, influxdb_type string").write.parquet(f"{folder}/file_columns.parquet")
    spark.createDataFrame(records, "file_id long, row_no int, record string").write.parquet(f"{folder}/file_records.parquet")
    __spark_entry__.queries()["p4_wide"](spark, str(folder)).write.parquet(f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


def test_every_table_with_columns_of_its_own(spark, tmp_path):
    columns = [
        (1, 1, "n", "I64", "Field"), (1, 2, "level", "F64", "Field"), (1, 3, "Level", "F64", "Field"), (1, 4, "_failed", "Bool", "Field"),
        (2, 1, "n", "I64", "Field"), (2, 2, "level", "String", "Tag"), (2, 3, "u.v", "U64", "Field"),
        (3, 1, "time", "Time", "Timestamp"), (3, 2, "level", "F64", "Field"),
    ]
    records = [
        (1, 1, '{"n": 1, "level": 1.5, "Level": 2.5, "_failed": true}'), (1, 2, None),
        (2, 1, '{"n": 2, "level": "high", "u.v": 18446744073709551615}'), (2, 2, '{"n": "x", "level": "low"}'),
        (3, 1, '{"time": 7, "level": 3.5}'), (4, 1, '{"n": 4}'), (9, 1, '{"n": 9}'),
    ]
    wide = stored(spark, tmp_path, columns, records)
    assert dict(wide.dtypes) == {
        "db_name": "string", "table_name": "string", "_file_id": "bigint", "_row_no": "int", "_failed": "string", "n": "bigint", "Level:F64": "double", "level:F64:2": "double",
        "level:String": "string", "_failed:Bool": "boolean", "u.v": "decimal(20,0)", "time": "bigint",
    }
    got = {(r["_file_id"], r["_row_no"]): {k: v for k, v in r.asDict().items() if v is not None and k not in ("_file_id", "_row_no")} for r in wide.collect()}
    assert got == {
        (1, 1): {"db_name": "d", "table_name": "a", "n": 1, "level:F64:2": 1.5, "Level:F64": 2.5, "_failed:Bool": True, "_failed": ""},
        (1, 2): {"db_name": "d", "table_name": "a", "_failed": ""},
        (2, 1): {"db_name": "d", "table_name": "b", "n": 2, "level:String": "high", "u.v": Decimal(18446744073709551615), "_failed": ""},
        (2, 2): {"db_name": "d", "table_name": "b", "level:String": "low", "_failed": "n I64 STRING x"},
        (3, 1): {"db_name": "e", "table_name": "a", "time": 7, "level:F64:2": 3.5, "_failed": ""},
        (4, 1): {"db_name": "e", "table_name": "c", "_failed": "n UNDECLARED BIGINT 4"},
        (9, 1): {"_failed": "n UNDECLARED BIGINT 9"},
    }


def test_records_without_any_declared_column(spark, tmp_path):
    wide = stored(spark, tmp_path, [], [(1, 1, '{"n": 1}'), (3, 1, "{}")])
    assert sorted(map(tuple, wide.collect())) == [("d", "a", 1, 1, "n UNDECLARED BIGINT 1"), ("e", "a", 3, 1, "")]
