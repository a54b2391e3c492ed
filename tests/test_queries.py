"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import os
from pathlib import Path

import pytest

from weftline.plans import registry

DATA = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or str(v) in ("nan", "NaT", "<NA>") else int(v) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted((tuple(str(clean(v)) for v in r) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
