"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from hustings.plans.registry import QUERIES as REGISTERED

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def cell(value):
    if value is None:
        return ""
    if isinstance(value, (float, Decimal)):
        return "" if math.isnan(value) else repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    expected = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(cell(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in expected)
    assert ours == theirs


def test_queries_without_sql_are_tested_by_brute_force():
    """Here only two, which test_operators.py compares; the corpus queries have tests of their own."""
    assert set(ORACLES) <= set(QUERIES)
    own = {n for n in QUERIES if n in REGISTERED}
    assert own - set(ORACLES) == {"hier_blocs", "near_misses"}


def test_entry_reads_the_smallest_tables(spark):
    assert contract.entry(spark).columns == ["side", "name1", "name2", "pct", "shared"]
