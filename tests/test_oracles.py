"""Every query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from jobstrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    said = duck.execute(catalogue.oracles()[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.collect(), got.columns) == rows(said.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_query_runs(spark, sf, name):
    assert len(catalogue.queries()[name](spark, sf).collect()) >= 0


def test_stream_equals_batch(spark, sf):
    q = catalogue.queries()
    pick = lambda df: sorted((r["id"], r["title"], str(r["removed_at"])) for r in df.collect())
    assert pick(q["str_feed_stream"](spark, sf)) == pick(q["str_feed"](spark, sf))
