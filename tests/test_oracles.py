"""Every registered query equals its SQL oracle (DuckDB) at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


KINDS = {"tinyint": "int", "smallint": "int", "bigint": "int", "float": "double"}
SQL_KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "int", "FLOAT": "double",
             "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    sql_kinds = {c: SQL_KINDS.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {c: k for c, k in kinds.items() if k in SQL_KINDS.values()} == {
        c: k for c, k in sql_kinds.items() if kinds[c] in SQL_KINDS.values()}
