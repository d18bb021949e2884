"""Robust multivariate outliers among documents, in DataFrame functions only.

Each document gives four transformed statistics: log of the mean word length, symbols a word,
repeated lines a word, and the share of words in repeated three-word windows. Per language and
source, centre and covariance are the minimum-covariance-determinant estimate: from each of three
fixed starts (medians with the ridge alone, medians with quartile spreads, mean and covariance of
all documents) concentration steps follow, each of which keeps the ``CORE`` share of documents
nearest by Mahalanobis distance and takes their mean and covariance. A start goes on as long as
its determinant falls; of all starts, the estimate with the smallest determinant is used. The
covariance is corrected for the cut core and gets a fixed ridge (the regularized form of the
estimate), as most statistics of clean prose are constant. A document is rejected when its squared
distance exceeds the chi-square quantile ``1 - TAIL``.

All sums are over fixed-point integers and all cuts lie on borders of histogram bins, so the
result does not depend on how rows are dealt out. Histograms and sums are partial aggregates:
a hot source moves no more rows than any other. Groups of fewer than ``MIN_GROUP`` documents (ten
for each statistic; a covariance of fewer says little) use the estimate of their language, and
small languages that of all documents.

Documents that fail the base rule (fewer than 50 words, or more than half of the words in
repeated windows) are rejected before and take no part in the estimates. Null and empty texts
have no words and fail it. Null languages and sources count as groups of their own. Repeated
rows count once each; other columns stay untouched; an empty table has no estimates and no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

CORE = 0.7
#: A step has to lower the logarithm of the determinant by so much to be followed by another.
FALL = 1e-3
TAIL = 1e-4
MIN_GROUP = 40
#: Standard deviations that are added, as what no document should be rejected for.
RIDGE = (0.06, 0.20, 0.50, 0.08)
#: Fixed point: values are multiples of 1 / SCALE.
SCALE = 1 << 16
#: Bins an octave of squared distance, and bins a unit for medians.
D_BINS, X_BINS = 8, 64
#: Standard deviations of a normal distribution in the distance of its quartiles.
NORMAL_QUARTILES = 0.7413

D = len(RIDGE)
#: Centre and Cholesky factor.
PARAMS = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i in range(D) for j in range(i + 1)]
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = "_q_"  # own columns, so that names of the documents can't clash


def _chi2(x: float, k: int) -> float:
    """Chi-square distribution for even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return high


CUTOFF = _chi2_quantile(1 - TAIL, D)
CONSISTENCY = CORE / _chi2(_chi2_quantile(CORE, D), D + 2)


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the five base statistics of each whole text, under own names (``_q_...``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    first = docs.withColumns(
        {
            f"{_P}w": words,
            f"{_P}word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            f"{_P}n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            f"{_P}l": lines,
        }
    )
    w, line = F.col(f"{_P}w"), F.col(f"{_P}l")
    n = F.size(w)
    triples = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("b"), F.slice(w, F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c"))
    hashes = F.transform(F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    second = first.select(
        *docs.columns,
        n.cast("long").alias(f"{_P}n_words"),
        f"{_P}word_chars",
        f"{_P}n_symbols",
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias(f"{_P}n_dup_lines"),
        hashes.alias(f"{_P}h"),
    )
    h = F.col(f"{_P}h")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    third = second.withColumn(f"{_P}s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    s = F.col(f"{_P}s")
    size = F.size(s)
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    near = F.arrays_zip(s.alias("x"), F.concat(none, F.slice(s, F.lit(1), size - 1)).alias("p"), F.concat(F.slice(s, F.lit(2), size - 1), none).alias("n"))
    twice = F.filter(near, lambda e: e["x"]["h"].eqNullSafe(e["p"]["h"]) | e["x"]["h"].eqNullSafe(e["n"]["h"]))
    starts = F.sort_array(F.transform(twice, lambda e: e["x"]["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"],
    )
    return third.withColumn(f"{_P}n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered)).drop(f"{_P}h", f"{_P}s")


def _stat(name: str) -> Column:
    return F.col(_P + name)


def base_failed() -> Column:
    return (_stat("n_words") < 50) | (100 * _stat("n_repeat_words") > 50 * _stat("n_words"))


def _transformed() -> list[Column]:
    """The four values in fixed point; 0 for documents without words."""
    n = F.greatest(_stat("n_words"), F.lit(1)).cast("double")
    values = [
        F.log(F.greatest(_stat("word_chars") / n, F.lit(1.0))),
        F.log1p(10 * _stat("n_symbols") / n),
        F.log1p(100 * _stat("n_dup_lines") / n),
        _stat("n_repeat_words") / n,
    ]
    return [F.round(v * SCALE).cast("long") for v in values]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{_P}lang": F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")), f"{_P}source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})


def _quantiles(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(key, axis, q0, q1, ...): per group and axis the least bins up to which these shares of the rows lie."""
    counted = rows.groupBy("key", "axis", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key", "axis")
    run = counted.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return run.groupBy("key", "axis").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("all")), F.col("bin"))).alias(f"q{k}") for k, share in enumerate(shares)])


def _distance(x: str = "x", p: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. to centre m0.. by the Cholesky factor l00..; forward substitution."""
    y: list[Column] = []
    for i in range(D):
        rest = F.col(f"{x}{i}") / F.lit(float(SCALE)) - F.col(f"{p}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{p}l{i}{j}") * y[j]
        y.append(rest / F.col(f"{p}l{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _sums() -> list[Column]:
    """Exact sums of the values and of their products."""
    x = [F.col(f"x{i}") for i in range(D)]
    sums = [F.sum(x[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(D)]
    return [F.count(F.lit(1)).alias("n"), *sums, *[F.sum((x[i] * x[j]).cast("decimal(20,0)")).alias(f"s{i}{j}") for i in range(D) for j in range(i, D)]]


def _with_factor(moments: DataFrame, consistency: float = CONSISTENCY) -> DataFrame:
    """Mean, Cholesky factor and log determinant (``ld``) from counts and sums; the ridge keeps the matrix positive."""
    n = F.col("n").cast("double")
    out = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / n / SCALE for i in range(D)})
    for i in range(D):
        for j in range(i + 1):
            cov = (F.col(f"s{j}{i}").cast("double") / n / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")) * consistency
            value = (F.greatest(cov, F.lit(0.0)) + RIDGE[i] ** 2) if i == j else cov
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # A rounding error can't make a pivot fall below a part of the ridge.
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(0.01 * RIDGE[i] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    ld = F.lit(0.0)
    for i in range(D):
        ld = ld + 2 * F.log(F.col(f"l{i}{i}"))
    return out.select("key", "start", "size", ld.alias("ld"), *PARAMS)


def _d_bin(d2: Column) -> Column:
    return F.floor(D_BINS * F.log2(d2 + 1e-6)).cast("int")


def _starts(leveled: DataFrame) -> DataFrame:
    """(key, start, active, size, ld, parameters) of the three starts; ``ld`` is not known yet."""
    x = [f"x{i}" for i in range(D)]
    each = leveled.select("key", F.posexplode(F.array(*[F.floor(F.col(c) * X_BINS / SCALE).cast("int") for c in x])).alias("axis", "bin"))
    wide = _quantiles(each, (0.25, 0.5, 0.75)).groupBy("key").pivot("axis", list(range(D))).agg(F.first(F.struct("q0", "q1", "q2")))
    spread = [F.sqrt(F.pow(F.lit(NORMAL_QUARTILES) * (F.col(f"`{i}`.q2") - F.col(f"`{i}`.q0")) / X_BINS, 2) + RIDGE[i] ** 2) for i in range(D)]
    diagonal = [[F.lit(RIDGE[i]) for i in range(D)], spread]
    centre = [((F.col(f"`{i}`.q1") + 0.5) / X_BINS).alias(f"m{i}") for i in range(D)]
    known = [F.lit(True).alias("active"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("ld")]
    out = _with_factor(leveled.groupBy("key").agg(*_sums()).withColumns({"size": F.col("n"), "start": F.lit(len(diagonal))}), 1.0).select("key", "start", *known, *PARAMS)
    for k, scale in enumerate(diagonal):
        out = out.unionByName(wide.select("key", F.lit(k).alias("start"), *known, *centre, *[(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]))
    return out


def _concentrated(leveled: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every start: mean and factor of the ``CORE`` share of its group that lies nearest."""
    near = leveled.join(params.select("key", "start", *PARAMS), "key").withColumn("bin", _d_bin(_distance()))
    counted = near.groupBy("key", "start", "bin").agg(*_sums())
    w = Window.partitionBy("key", "start")
    run = counted.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "size": F.sum("n").over(w)})
    core = run.filter(F.col("upto") - F.col("n") < F.ceil(F.lit(CORE) * F.col("size")))
    sums = [c for c in counted.columns if c not in ("key", "start", "bin")]
    return _with_factor(core.groupBy("key", "start").agg(F.first("size").alias("size"), *[F.sum(c).alias(c) for c in sums]))


def fit(stats: DataFrame) -> DataFrame:
    """One row for each (language, source) with what :func:`judge` needs. ``stats``: from :func:`with_stats`.

    The few numbers of each row are kept in the shared folder; groups are few beside documents.
    """
    rows = _keyed(stats).filter(~base_failed()).select(f"{_P}lang", f"{_P}source", *[v.alias(f"x{i}") for i, v in enumerate(_transformed())])
    rows = settled(rows, "quality-stats")
    lang, source = F.col(f"{_P}lang"), F.col(f"{_P}source")
    keys = F.array(F.struct(F.lit(0).alias("level"), lang.alias("lang"), source.alias("source")), F.struct(F.lit(1).alias("level"), lang.alias("lang"), F.lit("").alias("source")), F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")))
    x = [f"x{i}" for i in range(D)]
    leveled = rows.select(F.explode(keys).alias("key"), *x)

    params = settled(_starts(leveled), "quality-step")
    while True:
        new = _concentrated(leveled, params.filter("active")).select("key", "start", F.struct("size", "ld", *PARAMS).alias("new"))
        joined = params.join(new, ["key", "start"], "left")
        falls = F.coalesce(F.col("new.ld") < F.col("ld") - FALL, F.col("new").isNotNull() & F.col("ld").isNull())
        params = settled(joined.select("key", "start", falls.alias("active"), *[F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "ld", *PARAMS)]), "quality-step")
        if params.filter("active").isEmpty():
            break
    least = F.min(F.struct("ld", "start", "size", *PARAMS)).alias("best")
    params = params.groupBy("key").agg(least).select("key", "best.*").drop("start")
    level = {k: params.filter(F.col("key.level") == k) for k in range(3)}
    values = PARAMS
    groups = rows.select(lang, source).distinct()

    def of(k: int) -> DataFrame:
        return level[k].select(F.col("key.lang").alias(f"k{k}_lang"), F.col("key.source").alias(f"k{k}_source"), F.col("size").alias(f"k{k}_size"), *[F.col(c).alias(f"k{k}_{c}") for c in values])

    wide = groups.join(of(0), (F.col("k0_lang") == lang) & (F.col("k0_source") == source), "left").join(of(1), F.col("k1_lang") == lang, "left").join(of(2), F.col("k2_lang") == F.lit(""), "left")
    use = F.when(F.col("k0_size") >= MIN_GROUP, 0).when(F.col("k1_size") >= MIN_GROUP, 1).otherwise(2)
    return settled(wide.select(lang, source, use.alias("level"), *[F.when(use == 0, F.col(f"k0_{c}")).when(use == 1, F.col(f"k1_{c}")).otherwise(F.col(f"k2_{c}")).alias(c) for c in values]), "quality-fit")


def judge(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """``stats`` with ``_q_base_failed``, ``_q_distance2`` (null if the base fails) and ``_q_kept``."""
    own = stats.columns
    with_keys = _keyed(stats).withColumns({f"x{_P}{i}": v for i, v in enumerate(_transformed())})
    renamed = fitted.select(F.col(f"{_P}lang").alias(f"{_P}fl"), F.col(f"{_P}source").alias(f"{_P}fs"), *[F.col(c).alias(f"{_P}{c}") for c in fitted.columns if c[0] in "ml" and c not in ("level",)])
    joined = with_keys.join(renamed, (F.col(f"{_P}lang") == F.col(f"{_P}fl")) & (F.col(f"{_P}source") == F.col(f"{_P}fs")), "left")
    total = _distance(f"x{_P}", _P)
    failed = base_failed()
    out = joined.select(*own, failed.alias(f"{_P}base_failed"), F.when(~failed, total).alias(f"{_P}distance2"))
    return out.withColumn(f"{_P}kept", ~F.col(f"{_P}base_failed") & (F.coalesce(F.col(f"{_P}distance2"), F.lit(0.0)) <= CUTOFF))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: its statistics, base verdict, squared distance and verdict."""
    stats = settled(with_stats(docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))])).drop("text"), "quality-all")
    out = judge(stats, fit(stats))
    return out.select("doc_id", *[F.col(_P + c).alias(c) for c in (*STATS, "base_failed", "kept", "distance2")])


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are read twice and never written.

    Null and empty texts go, as they fail the base rule; repeated rows and ties are judged alike;
    an empty table stays empty; any other columns, also ones named like statistics, pass through.
    """
    narrow = settled(with_stats(docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])).drop("text"), "quality-all")
    stats = with_stats(docs)
    own = [c for c in stats.columns if c not in docs.columns]
    # The filter refers to columns of a generator, so the optimizer can't move the statistics into it and repeat them.
    held = stats.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*own))))
    return judge(held, fit(narrow)).filter(f"{_P}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
