"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, (bool, int, str, float)) else str(v)


def ordered(rows, names):
    """Rows with their values by name, sorted by what is exact first and by coarse floats last."""
    at = [names.index(n) for n in sorted(names)]
    values = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(values, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [f"{v:.3f}" for v in r if isinstance(v, float)]))


def equal(a, b):
    """Floats may differ by the last of six places, where either side has rounded a tie its way."""
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6) if isinstance(a, float) and isinstance(b, (int, float)) else a == b


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, SF)
    found = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = ordered([tuple(r) for r in df.collect()], df.columns), ordered(found.fetchall(), names)
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if not all(map(equal, a, b))]
    assert not different, different[:2]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
