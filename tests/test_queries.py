"""Every query with SQL gives DuckDB's rows on the smallest tables; the rest give rows."""

import os

import duckdb
import pytest

from ledgerlake.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        path = f"{DIR}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DIR)
    rows = [tuple(plain(x) for x in r) for r in df.collect()]
    if name not in oracle_sql():
        assert rows
        return
    found = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    place = [found.columns.index(c) for c in df.columns]
    want = [tuple(plain(r[k]) for k in place) for r in found.fetchall()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_every_query_is_listed(spark):
    import __spark_entry__

    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) <= set(queries())
    assert __spark_entry__.entry(spark).columns == ["date", "label", "items", "bytes"]


def test_outer_join_has_every_error_and_click(spark, duck):
    rows = queries()["active_outer_join"](spark, DIR).collect()
    users, both = duck.sql("select count(distinct user_id), count(distinct (user_id, props)) from events where event_type in ('error', 'click')").fetchall()[0]
    assert len({r.key.split(":")[0] for r in rows}) == users and len(rows) == both
    assert {(r.bytes_total > 0, r.bytes_done > r.bytes_total) for r in rows} == {(False, False), (False, True), (True, False), (True, True)}
    assert all((r.percent is None) == (r.bytes_total == 0) for r in rows)


def test_resumable_orders_come_first(spark, duck):
    rows = queries()["pending_cap50"](spark, DIR).collect()
    want = duck.sql("select cast(o_orderkey as varchar) from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT' and cast(o_orderdate as date) > (select cast(max(o_orderdate) as date) from orders) - interval 30 day order by 1").fetchall()
    assert 0 < len(want) < 50 and [r.key for r in rows if r.section == 0] == [k for (k,) in want] and len(rows) == 50
    assert {r.section for r in queries()["pending_busy_cap50"](spark, DIR).collect()} == {1}
