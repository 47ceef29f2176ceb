"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from netquarry.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = Counter(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert got
    if name in ORACLE_SQL:
        cursor = duck.execute(f"SELECT * FROM ({ORACLE_SQL[name]})")
        found = [d[0] for d in cursor.description]
        assert sorted(found) == columns
        order = [found.index(c) for c in columns]
        want = Counter(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())
        assert got == want


def test_entry_imports():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(QUERIES) <= set(names)
