"""All registered queries against their SQL, on the smallest data."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from conftest import DATA
from evidence_spark.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(value(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rule_name", "machine", "n", "score"]
    assert df.count() > 0
