"""Every warehouse query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tideline.plans import catalog, scalar_queries, stream_queries, warehouse  # noqa: F401

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    from tideline.plans.ship import ship

    df = QUERIES[name](ship(spark), sf)
    expected = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    want = expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)
    assert got, "the query must return rows"


def test_entry_reads_the_tables(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1


def test_entry_works_without_the_llm_folders(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES)
