"""Maps that keep the first entry, over rows that their order leaves equal."""

from __future__ import annotations

import duckdb
import pytest

from kmerloom.plans import registry


@pytest.mark.parametrize("name", ["map_first_wins", "sorted_map_order"])
def test_first_in_the_file_wins_ties(spark, tmp_path, name):
    lines = f"'{tmp_path}/lineitem.parquet'"
    values = "SELECT CASE WHEN i % 41 = 0 THEN NULL ELSE i % 37 END::BIGINT AS l_partkey, (i % 3)::BIGINT AS l_orderkey, 1 AS l_linenumber, i::DOUBLE AS l_quantity FROM range(4000) t(i) ORDER BY i"
    con = duckdb.connect()
    con.sql(f"COPY ({values}) TO {lines}")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM {lines}")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall()) and len(got) == 38
