"""Every query of the library that has SQL, against DuckDB over the smallest tables."""
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from galley.plans import catalogue, planted, relations, workflows  # noqa: F401  (these add their queries to the first)

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_and_sql_agree(spark, duck, name):
    found = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    asked = duck.execute(catalogue.oracles()[name])
    named = [c[0] for c in asked.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in at) for row in asked.fetchall())
    assert want, "a query without rows shows nothing"
    assert Counter(tuple(map(plain, row)) for row in found.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracles())
