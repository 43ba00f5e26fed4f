import math

import duckdb
import pytest

from shutterloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    number = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(number(v) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = got.select(*columns).collect()
    assert plain(map(tuple, rows)) == plain(want.fetchall())
    assert rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
