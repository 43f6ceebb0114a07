"""Every registered query against its SQL counterpart on the smallest tables."""
import datetime
import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sitelode.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    if name in entry.oracle_sql():
        cursor = duck.execute(entry.oracle_sql()[name])
        assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_operators(tmp_path, pipeline):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sitelode", tmp_path / "sitelode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{root}/corpus_pipeline.py")):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], out.stderr
