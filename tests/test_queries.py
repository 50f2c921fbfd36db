"""Every catalogue query against its SQL oracle, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sketchloom import plans

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SMALL)
    found = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_ordered(spark, name):
    df = plans.queries()[name](spark, SMALL)
    one = rows_of(df.columns, [tuple(r) for r in df.collect()])
    again = plans.queries()[name](spark, SMALL)
    assert one and one == rows_of(again.columns, [tuple(r) for r in again.collect()])


#: Queries of filters that change from key to key, held against SQL on a larger table too.
REPLAYED = "scalable_bloom_layers scalable_bloom_contains bs_dedup bssd_dedup rlbs_dedup".split()


@pytest.mark.parametrize("name", REPLAYED)
def test_replayed_filters(spark, name):
    import duckdb

    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = plans.queries()[name](spark, d)
    found = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, found.fetchall())
    if "dedup" in name:  # the filter forgets: some repeated customers count as distinct again
        assert sum(r[df_at(df, "is_distinct")] for r in got) > spark.read.parquet(f"{d}/orders.parquet").select("o_custkey").distinct().count()


def df_at(df, name: str) -> int:
    return sorted(df.columns).index(name)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
