"""The registered queries against their SQL, and the library without the text subpackage."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TEXT = {n for n in __spark_entry__.queries() if n.startswith(("p6_", "p7_", "p8_"))}
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if type(v).__name__ in ("datetime", "date") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) - TEXT))
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@needs_data
def test_entry(spark):
    assert sorted(__spark_entry__.entry(spark).columns) == ["event_type", "time", "user_id", "value"]


def test_library_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    script = "import __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and 'write_read' in n and not [x for x in n if x[:2] in ('p6', 'p7', 'p8')]; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
    shutil.rmtree(tmp_path / "tidemark/queries")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, check=False, capture_output=True, env={**os.environ, "PYTHONPATH": ""})
    assert broken.returncode != 0
