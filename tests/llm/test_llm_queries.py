"""Registered queries of the subpackage over the smallest test tables, against their SQL where there is any."""

import glob
import os

import duckdb
import pytest

from sieve.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    table = "pages" if name.startswith(("op3_", "op8_")) else "documents"
    assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        result = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_pipeline_query(spark):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
