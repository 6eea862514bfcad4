"""Every registered query of the rest of the library against its DuckDB form."""

import datetime
import decimal
import math

import duckdb
import pytest

from tallyglass.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(registry.oracle_sql()[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    mine = sorted(repr([_norm(r[c]) for c in columns]) for r in df.collect())
    other = sorted(repr([_norm(r[theirs.index(c)]) for c in columns]) for r in result.fetchall())
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and len(df.collect()) > 0
