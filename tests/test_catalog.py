"""Every registered query of the engine against its SQL on the same tables."""

import datetime
import math

import duckdb
import pytest

from nearfield import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, oracle, name):
    found = catalog.queries()[name](spark, sf_dir)
    got = table(found.columns, [tuple(r) for r in found.collect()])
    assert got[1]
    if name in catalog.oracle_sql():
        cursor = oracle.execute(catalog.oracle_sql()[name])
        assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
