"""Every registered catalog query against DuckDB on the same tables."""

import os

import duckdb
import pytest
from conftest import SF

from assetlake.plans import queries, registry as Q, state_queries  # noqa: F401  they register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, wanted = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).schema.names


def test_debounce_against_a_loop(spark):
    got = [tuple(r) for r in Q.QUERIES["debounced_events"](spark, SF).orderBy("root_id", "fired_at").collect()]
    events = duckdb.sql(f"select user_id % 10, epoch_us(ts) from '{SF}/events.parquet' where event_type in ('click', 'view', 'purchase') order by 1, 2").fetchall()
    last, wanted = {}, []
    for root, at in events:
        if root not in last or at - last[root] >= 60_000_000:
            last[root] = at
            wanted.append((root, at))
    assert got == wanted


def test_entry_has_rows(spark):
    import __spark_entry__

    assert os.path.isdir("/root/testdata/sf0.001") and __spark_entry__.entry(spark).count() > 0
