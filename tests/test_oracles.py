"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math
import os

import pytest
from dossier import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return "decimal " + str(value)
    if isinstance(value, (list, tuple)):
        return [shown(x) for x in value]
    return repr(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([shown(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees(spark, small_dir, duck, name):
    df = registry.QUERIES[name](spark, small_dir)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert table(df.columns, df.collect()) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small_dir, name):
    df = registry.QUERIES[name](spark, small_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.collect()  # what is in the rows is tested against plain Python, operator by operator


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
