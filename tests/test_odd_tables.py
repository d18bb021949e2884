"""Queries against their SQL on tables that the given ones do not cover: odd texts, more rows than a fixed number."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlake.queries import oracle_sql, queries

from .test_queries import DIR, plain

pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no tables here")


@pytest.fixture
def agrees(spark, tmp_path):
    """Holds a query against its SQL on the smallest tables, some of them replaced."""

    def check(name, **changed):
        duck = duckdb.connect()
        for p in Path(DIR).glob("*.parquet"):
            to = tmp_path / p.name
            if p.stem in changed:
                changed[p.stem].write.parquet(str(to))
            else:
                to.symlink_to(p)
            duck.execute(f"create view {p.stem} as select * from read_parquet('{f'{to}/*.parquet' if to.is_dir() else to}')")
        df = queries()[name](spark, str(tmp_path))
        found = duck.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({oracle_sql()[name]})").fetchall()
        rows = [tuple(plain(x) for x in r) for r in df.collect()]
        assert sorted(map(str, rows)) == sorted(str(tuple(plain(x) for x in r)) for r in found)
        return rows

    return check


def test_title_text_leaves_cut_references(spark, agrees):
    titles = ["and&amp;&amp;&amp", "a &amp;quot; b&quot", " x  ", "　y\x0b\tz ", "&lt;b&gt; &#39;c&#39;", "&nbsp;d&copy", "", "two lines\n"]
    pages = [(k, "u", f"<h1>{x}</h1>") for k, x in enumerate(titles)] + [(90, "u", None), (91, "u", "no heading")]
    got = dict(agrees("title_text", pages=spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert got[0] == "and&&&amp" and got[1] == 'a &quot; b&quot'


def test_snapshot_of_more_items_than_links(spark, agrees):
    """The told number of raw links is fixed: with more items the difference is below 0."""
    one = spark.range(100_003).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    rows = agrees("snapshot_of_ledgers", customer=one)
    assert ("idle", "fact", "duplicates", "", -3, "") in rows
