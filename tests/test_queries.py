"""Registered queries: the contract, results against their SQL, and independence of the optional subpackage."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sieve import queries as selection

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(selection.QUERIES))
def test_query(spark, duck, name):
    df = selection.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in selection.ORACLE_SQL:
        result = duck.execute(selection.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(selection.QUERIES) <= set(entry.queries())


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(entry.__file__)
    for part in ("sieve", "__spark_entry__.py"):
        os.symlink(f"{root}/{part}", tmp_path / part) if part.endswith(".py") else None
    os.mkdir(tmp_path / "sieve")
    for part in os.listdir(f"{root}/sieve"):
        if part != "llm":
            os.symlink(f"{root}/sieve/{part}", tmp_path / "sieve" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
