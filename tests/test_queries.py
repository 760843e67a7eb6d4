"""Every query of the reference's operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from docloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    value = lambda v: round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, str, bool)) else str(v)
    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name in catalog.oracle_sql():
        got = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        assert plain(rows) == plain([tuple(r[names.index(c)] for c in cols) for r in got.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(__spark_entry__.SMOKE)
    assert __spark_entry__.entry(spark).count() > 0
