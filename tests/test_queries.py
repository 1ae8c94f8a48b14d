"""Queries of rules, readers and writers against their SQL."""

import math

import duckdb
import pytest

from evalweave import answer_queries, file_queries, plan_queries, queries, rule_queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ in (answer_queries.__name__, rule_queries.__name__, file_queries.__name__, plan_queries.__name__)]


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, base, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = base.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = [tuple(r[at.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, map(plain, got.select(*columns).collect()))) == sorted(map(repr, map(plain, want)))
