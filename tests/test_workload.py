"""Registered queries against their SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def order(row):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


FAST = ["series_pct_change_page", "indicator_coverage", "trend_table", "keep_first", "district_ranking", "audited_upsert",
        "correlation_matrix_spearman", "hierarchy_reconciliation", "census_observations", "report_lines", "payload_observations"]


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FAST)
def test_query_matches_sql(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in where) for r in rel.fetchall()), key=order)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(y, float) else y)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
