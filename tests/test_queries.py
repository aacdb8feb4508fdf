"""Every registered query of the library against its SQL."""

from decimal import Decimal
from math import isclose

import duckdb
import pytest

from loomery.plans import registry
from loomery.sources.tables import TABLES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    return float(v) if isinstance(v, Decimal) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(round(x, 6)) if isinstance(x, float) else str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    got = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    wanted = _rows(names, got.fetchall())
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        for x, y in zip(a, b):
            assert (isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and y is not None else x == y), (a, b)


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "path"] and df.count() > 0


def test_names_of_sql_are_names_of_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
