import math
import os

import duckdb
import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(rows, columns):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_oracle(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLES[name])
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == rows_of(result.fetchall(), [c[0] for c in result.description])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
