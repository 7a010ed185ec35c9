"""Every registered query of the engine against its SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from kmerloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(plain(x) for x in r) for r in got.select(*want.columns).collect())
    assert rows == Counter(tuple(plain(x) for x in r) for r in want.fetchall())


def test_entry_and_names(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
