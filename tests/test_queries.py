"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import pytest
from conftest import DATA

from quern.plans.registry import ORACLES, QUERIES


def plain(rows) -> list[tuple]:
    cell = lambda v: ("nan" if math.isnan(v) else repr(float(v))) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in ORACLES:
        assert rows
        return
    sql = f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})"
    assert plain(rows) == plain(duck.sql(sql).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
