"""How the sources of a language differ in their words, audited shard by shard in DuckDB.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. Texts are
counted where they are read: DuckDB splits and counts each batch, a task gathers its counts before
it sends them. Counts are dealt into shards by (language, term), so that all of a term is in one
shard: its documents, its count in the language and in every source. In each shard DuckDB then

* drops terms in fewer than ``least`` documents of the language,
* adds up, for each pair of sources, how far their shares of each term lie apart, and
* ranks the terms that a source uses more than its language does.

Spark adds up the partial sums and merges the rankings. A share is
``1 + floor(scale * (count + alpha) / (N + alpha * V))`` in whole numbers, so results do not depend
on how rows are dealt. A pair of sources that both lack a term differs by the same amount for every
such term; those terms are counted and never listed, so work follows the terms that occur.

Hot sources and words are small here, as counts of a task travel and not occurrences. A shard holds
a share of the vocabulary, and shards grow in number with the partitions of a shuffle. Sums of pairs
are as many as the result's rows, times the shards.

Null texts, languages and sources are read as empty; a group without terms still has its rows.
Every row is a document of its own, repeated ones too. Terms of equal value are ranked by their
UTF-8 bytes. No documents give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cluster_width, pieces, settled

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of counts that a task holds before it sends them on, and memory of DuckDB in a task.
HOLD = 1 << 19
MEMORY = "400MB"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
    _done(con, "SET enable_progress_bar = false")
    return con


def _done(con, text: str) -> list:
    """A statement run to its end; the connection then takes the next."""
    return con.execute(text).fetchall()


def _rows(result, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in result.to_arrow_reader(1 << 16):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), *((c, pa.int64()) for c in ("own", "lone", "lone_terms", "terms"))])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents, several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        _done(con, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        held = 0
        for batch in pieces(batches):
            con.register("given", pa.Table.from_batches([batch]))
            held += _done(
                con,
                f"""INSERT INTO held
                SELECT lang, source, term, sum(n), count(*) FROM (
                  SELECT i, lang, source, term, count(*) AS n FROM (
                    SELECT row_number() OVER () AS i, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')) AS term FROM given)
                  GROUP BY i, lang, source, term)
                GROUP BY lang, source, term""",
            )[0][0]
            con.unregister("given")
            if held >= HOLD:
                _done(con, "CREATE OR REPLACE TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
                held = _done(con, "SELECT count(*) FROM held")[0][0]
                if held >= HOLD // 2:
                    yield from _rows(con.execute("SELECT * FROM held"), _COUNTED)
                    _done(con, "DELETE FROM held")
                    held = 0
        yield from _rows(con.execute("SELECT lang, source, term, sum(n), sum(docs) FROM held GROUP BY ALL"), _COUNTED)
        con.close()

    return docs.select("lang", "source", "text").mapInArrow(run, _ddl(_COUNTED))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, first) of terms in ``least`` documents of their language; ``first`` is 1 once a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        _done(con, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        fresh, whole = 0, 0
        for batch in batches:
            con.register("given", pa.Table.from_batches([batch]))
            _done(con, "INSERT INTO held SELECT * FROM given")
            con.unregister("given")
            fresh += batch.num_rows
            if fresh >= max(HOLD, whole):  # one row a key again
                _done(con, "CREATE OR REPLACE TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
                fresh, whole = 0, _done(con, "SELECT count(*) FROM held")[0][0]
        found = con.execute(
            f"""WITH one AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM held GROUP BY ALL),
            kept AS (SELECT lang, term, min(source) AS least FROM one GROUP BY ALL HAVING sum(docs) >= {int(least)})
            SELECT lang, source, term, n, (source = least)::BIGINT FROM one JOIN kept USING (lang, term)"""
        )
        yield from _rows(found, _KEPT)
        con.close()

    spark = counts.sparkSession
    return counts.repartition(cluster_width(spark), "lang", "term").mapInArrow(run, _ddl(_KEPT))


def _parts(rows: DataFrame, alpha: int, scale: int, top: int) -> DataFrame:
    """Partial sums of pairs and the best terms of each task's shards; rows without a term are totals of a group."""

    def share(n: str, total: str) -> str:
        return f"(1 + ({scale}::HUGEINT * ({n} + {alpha})) // ({total} + {alpha} * v))::BIGINT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        _done(con, "CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        _done(con, "CREATE TABLE given_groups (lang VARCHAR, source VARCHAR, total BIGINT, whole BIGINT, v BIGINT)")
        for batch in batches:
            con.register("given", pa.Table.from_batches([batch]))
            _done(con, "INSERT INTO counts SELECT lang, source, term, n FROM given WHERE term IS NOT NULL")
            _done(con, "INSERT INTO given_groups SELECT lang, source, total, whole, v FROM given WHERE term IS NULL")
            con.unregister("given")
        _done(con, f"CREATE TABLE groups AS SELECT DISTINCT *, CASE WHEN v > 0 THEN {share('0', 'total')} END AS none FROM given_groups")
        _done(con, f"CREATE TABLE shares AS SELECT lang, source, term, n, {share('n', 'total')} AS p, whole, v FROM counts JOIN groups USING (lang, source)")
        pairs = """SELECT 'pair', a.lang, a.source, b.source, sum(abs(a.p - coalesce(x.p, b.none))),
              coalesce(sum(abs(a.p - b.none)) FILTER (WHERE x.p IS NULL), 0), count(*) FILTER (WHERE x.p IS NULL), count(*)
            FROM shares a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN shares x ON x.lang = a.lang AND x.term = a.term AND x.source = b.source
            GROUP BY a.lang, a.source, b.source"""
        terms = f"""SELECT 'term', lang, source, term, p - q, 0, 0, 0 FROM (
              SELECT lang, source, term, n, p, {share('of_lang', 'whole')} AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS of_lang FROM shares))
            WHERE n > 0 AND p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {int(top)}"""
        for text in (pairs, terms):
            yield from _rows(con.execute(text), _PARTS)
        con.close()

    return rows.mapInArrow(run, _ddl(_PARTS))


def audit(docs: DataFrame, least: int = 30, alpha: int = 5, scale: int = 10**9, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the terms used most beyond it."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = settled(kept_terms(term_counts(docs), least), "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.sum("first").alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = settled(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "whole", "v"))), "divergence-groups")

    n = cluster_width(spark)
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("total", "long"), ("whole", "long"), ("v", "long"))]
    everywhere = groups.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "whole", "v")
    rows = kept.select(shard, "lang", "source", "term", "n", *none).unionByName(everywhere).repartitionById(n, "shard").drop("shard")
    parts = settled(_parts(rows, alpha, scale, top), "divergence-parts")

    apart = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(*(F.sum(c).alias(c) for c in ("own", "lone", "lone_terms", "terms")))
    share = F.when(F.col("v") > 0, F.expr(f"1 + div({scale} * {alpha}L, total + {alpha} * v)")).otherwise(0)
    sides = groups.select("lang", "source", "v", share.alias("none"))
    pairs = sides.join(sides.select("lang", F.col("source").alias("item"), F.col("none").alias("none_there")), "lang").filter("source <> item")
    back = apart.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("lone").alias("lone_there"), F.col("lone_terms").alias("lone_terms_there"))
    pairs = pairs.join(apart.select("lang", "source", "item", "own", "terms"), ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left")
    pairs = pairs.na.fill(0, ["own", "terms", "lone_there", "lone_terms_there"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("own + lone_there + (v - terms - lone_terms_there) * abs(none - none_there)").alias("value"))

    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", F.col("own").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.filter(f"part = 'pair' OR rank <= {int(top)}")


#: The same rows by plain SQL over dense tables of shares.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
