"""Every query by name, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..operators import knn, quantised, tree, warping, words
from ..sources import floats, tables
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LENGTH, SEGMENTS, CARDINALITY = 64, 16, 256


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL where it has any."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def asked(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The query set: every fiftieth id."""
    return df.where(F.col(id_col) % 50 == 0)


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for an index: in the folder that driver and executors share, or in a temporary one where all runs in one process. It
    goes when the driver ends."""
    shared, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared or _own_folder()}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once: what several passes read should not be derived in each."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# SQL that others build on.
E_ = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_Z = "{to} AS (SELECT vec_id, label, CASE WHEN s > 1e-12 THEN list_transform(v, lambda x: (x - m) / s) ELSE list_transform(v, lambda x: 0.0) END AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS s FROM (SELECT *, list_sum(v) / len(v) AS m FROM {of})))"
Z_ = f"{E_}, {_Z.format(to='z', of='e')}"
W_ = f"{E_}, c AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: list_sum(v[1:i])) AS v FROM e), {_Z.format(to='w', of='c')}"


def _knn_sql(prelude: str, of: str, k: int, where: str = "true", who: str = "vec_id % 50 = 0", key: str = "vec_id") -> str:
    return f"""WITH {prelude}, q AS (SELECT {key} AS q_id, v AS qv FROM {of} WHERE {who}),
d AS (SELECT q_id, {key} AS vec_id, list_distance(qv, v) AS dist FROM q, {of} WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= {k}"""


def _rows(df: DataFrame, array: Column, value: str = "value", place: str = "pos", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias(place, value))


# Brute force.


def _scan(k: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = tables.embeddings(spark, sf_dir)
        return knn.knn_join(e, asked(e), k)

    return run


for _k in (1, 5, 10, 100):
    query(_knn_sql(E_, "e", _k), f"knn_scan_k{_k}")(_scan(_k))


@query(f"""WITH {E_}, q AS (SELECT vec_id AS q_id, v AS qv FROM e WHERE vec_id % 50 = 0),
d AS (SELECT q_id, round(list_distance(qv, v) ** 2, 12) AS d2, min(vec_id) AS vec_id FROM q, e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, vec_id) AS rank FROM d)
SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(sqrt(d2), 6) AS dist FROM r WHERE rank <= 10""")
def knn_distinct_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return knn.knn_join(e, asked(e), 10, distinct=True, keep=kept)


@query(_knn_sql(E_, "e", 10, "q_id <> vec_id"))
def knn_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return knn.knn_join(e, asked(e), 10, exclude_self=True)


@query(_knn_sql(E_, "e", 5, who="vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 7 OFFSET 20)"))
def knn_query_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries 20 to 26 in the order of ids: a slice of the query table is the feature."""
    e = tables.embeddings(spark, sf_dir)
    return knn.knn_join(e, tables.query_slice(e, 20, 7), 5)


@query(f"""WITH {E_}, d AS (SELECT q.vec_id AS q_id, e.vec_id, list_distance(q.v, e.v) AS dist FROM e AS q, e WHERE q.vec_id % 50 = 0)
SELECT q_id, vec_id, round(dist, 6) AS dist FROM d WHERE dist < 1.2""")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return knn.range_search(e, asked(e), 1.2)


_VOTE = """, j AS (SELECT r.q_id, t.label, r.rank FROM r JOIN e AS t USING (vec_id) WHERE r.rank <= {k}),
n AS (SELECT q_id, label, count(*) AS votes, max(rank) AS reached FROM j GROUP BY 1, 2)
SELECT q_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, reached) AS place FROM n) WHERE place = 1"""


@query(f"""WITH {E_}, d AS (SELECT q.vec_id AS q_id, e.vec_id, list_distance(q.v, e.v) AS dist FROM e AS q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rank FROM d){_VOTE.format(k=5)}""")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return knn.classify(e, asked(e), 5)


# Functions of a series.


@query(f"""WITH {E_} SELECT vec_id, round(m, 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)), 6) AS sd
FROM (SELECT *, list_sum(v) / len(v) AS m FROM e)""")
def znorm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return e.select("vec_id", F.round(series.mean(F.col("v")), 6).alias("mean"), F.round(series.sd(F.col("v")), 6).alias("sd"))


@query(f"WITH {Z_} SELECT vec_id, CAST(i AS INTEGER) AS pos, round(v[i + 1], 6) AS value FROM (SELECT *, unnest(range(0, 64)) AS i FROM z)")
def znorm_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return _rows(z, F.transform("v", lambda x: F.round(x, 6)))


_PAA = "list_transform(range(0, 16), lambda i: list_sum(v[4 * i + 1:4 * i + 4]) / 4)"


@query(f"WITH {Z_}, p AS (SELECT vec_id, {_PAA} AS p FROM z) SELECT vec_id, CAST(i AS INTEGER) AS pos, round(p[i + 1], 6) AS value FROM (SELECT *, unnest(range(0, 16)) AS i FROM p)")
def paa16(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return _rows(z, F.transform(series.paa(F.col("v"), SEGMENTS, LENGTH), lambda x: F.round(x, 6)))


_SEG = "s AS (SELECT vec_id, i, list_sum(v[16 * i + 1:16 * i + 16]) / 16 AS m, v[16 * i + 1:16 * i + 16] AS p FROM (SELECT *, unnest(range(0, 4)) AS i FROM {of})), t AS (SELECT vec_id, i, m, sqrt(list_sum(list_transform(p, lambda x: (x - m) * (x - m))) / 16) AS sd FROM s)"


@query(f"WITH {W_}, {_SEG.format(of='w')} SELECT vec_id, CAST(i AS INTEGER) AS pos, round(m, 6) AS mean, round(sd, 6) AS sd FROM t")
def segment_stats4(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    rows = _rows(w, series.segment_stats(F.col("v"), series.equal_segments(LENGTH, 4)), "s")
    return rows.select("vec_id", "pos", F.round("s.mean", 6).alias("mean"), F.round("s.sd", 6).alias("sd"))


def _cuts(cardinality: int) -> str:
    return "[" + ", ".join(f"CAST({b!r} AS DOUBLE)" for b in series.breakpoints(cardinality)) + "]"


def _word(of: str, cardinality: int = CARDINALITY) -> str:
    return f"b AS (SELECT {_cuts(cardinality)} AS cuts), p AS (SELECT vec_id, {_PAA} AS p FROM {of}), x AS (SELECT vec_id, p, list_transform(p, lambda y: len(list_filter(cuts, lambda c: c < y))) AS word FROM p, b)"


@query(f"WITH {Z_}, {_word('z')} SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(word[i + 1] AS INTEGER) AS symbol FROM (SELECT *, unnest(range(0, 16)) AS i FROM x)")
def sax_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return _rows(z, series.sax(F.col("v"), SEGMENTS, LENGTH, CARDINALITY), "symbol")


@query(f"WITH {Z_}, {_word('z')} SELECT vec_id, array_to_string(list_transform(word, lambda s: lpad(bin(s), 8, '0')), ' ') AS word FROM x")
def sax_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return z.select("vec_id", series.sax_bits(series.sax(F.col("v"), SEGMENTS, LENGTH, CARDINALITY), 8).alias("word"))


@query(f"WITH {Z_}, {_word('z')} SELECT vec_id, CAST(list_sum(list_transform(range(0, 16), lambda i: (word[i + 1] // 128) * (2 ** (15 - i)))) AS BIGINT) AS mask FROM x")
def root_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return z.select("vec_id", series.root_mask(series.sax(F.col("v"), SEGMENTS, LENGTH, CARDINALITY), 8).alias("mask"))


def _dft(of: str, n: int = 8) -> str:
    return f"""f AS (SELECT vec_id, k, list_sum(list_transform(range(0, 64), lambda t: v[t + 1] * cos(2 * pi() * k * t / 64))) / 8 AS re, -list_sum(list_transform(range(0, 64), lambda t: v[t + 1] * sin(2 * pi() * k * t / 64))) / 8 AS im
FROM (SELECT *, unnest(range(1, {n + 1})) AS k FROM {of})), g AS (SELECT vec_id, 2 * (k - 1) AS dim, re AS x FROM f UNION ALL SELECT vec_id, 2 * (k - 1) + 1, im FROM f)"""


@query(f"WITH {Z_}, {_dft('z')} SELECT vec_id, CAST(dim AS INTEGER) AS pos, round(x, 6) + 0.0 AS value FROM g")
def dft8(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    return _rows(z, F.transform(series.dft(F.col("v"), LENGTH, 8), lambda x: F.round(x, 6) + 0.0))


@query(f"WITH {E_} SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY abs(v[i + 1]) DESC, i) - 1 AS INTEGER) AS pos, CAST(i AS INTEGER) AS dim FROM (SELECT *, unnest(range(0, 64)) AS i FROM e WHERE vec_id % 50 = 0)")
def query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(asked(tables.embeddings(spark, sf_dir)), series.query_order(F.col("v")), "dim")


_ENV = "list_transform(range(0, 64), lambda i: list_{f}(v[greatest(0, i - 5) + 1:least(64, i + 6)])) AS {n}"


@query(f"WITH {Z_}, u AS (SELECT vec_id, {_ENV.format(f='max', n='hi')}, {_ENV.format(f='min', n='lo')} FROM z) SELECT vec_id, CAST(i AS INTEGER) AS pos, round(hi[i + 1], 6) AS upper, round(lo[i + 1], 6) AS lower FROM (SELECT *, unnest(range(0, 64)) AS i FROM u)")
def envelope_r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.normalised(tables.embeddings(spark, sf_dir))
    rows = _rows(z, series.envelope(F.col("v"), LENGTH, 5), "e")
    return rows.select("vec_id", "pos", F.round("e.upper", 6).alias("upper"), F.round("e.lower", 6).alias("lower"))


# Bounds for each query and row.


#: Rows of a query set that meet all rows at once.
QUERY_ROWS = 4096


def against(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The stated query set against all rows: a bounded block of queries at a time is broadcast, so neither side is shuffled and nothing
    broadcast grows with the data."""
    spark, out, held = rows.sparkSession, None, []

    def meet() -> None:
        nonlocal out
        part = rows.join(F.broadcast(spark.createDataFrame(held, queries.schema)))
        out = part if out is None else out.unionByName(part)
        held.clear()

    for r in queries.repartition(8).toLocalIterator():  # the shuffle lets the scan for the queries run in parallel
        held.append(r)
        if len(held) == QUERY_ROWS:
            meet()
    if held or out is None:
        meet()
    return out


def _pairs(data: DataFrame, summary: Column) -> DataFrame:
    held = data.select("vec_id", "v", summary.alias("s"))
    return against(asked(held).select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"), F.col("s").alias("qs")), held)


def _sax_lb(of: str, prelude: str, out: str) -> str:
    return f"""WITH {prelude}, {_word(of)}, y AS (SELECT vec_id, p, word, [CAST(-1e300 AS DOUBLE)] || cuts AS lo, cuts || [CAST(1e300 AS DOUBLE)] AS hi FROM x, b),
l AS (SELECT q.vec_id AS q_id, y.vec_id, 4 * list_sum(list_transform(range(1, 17), lambda i: greatest(y.lo[y.word[i] + 1] - q.p[i], q.p[i] - y.hi[y.word[i] + 1], 0) ** 2)) AS lb FROM y AS q, y WHERE q.vec_id % 50 = 0)
{out}"""


@query(_sax_lb("w", W_, "SELECT q_id, vec_id, round(sqrt(lb), 6) AS lb FROM l"))
def sax_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    means = series.paa(v, SEGMENTS, LENGTH)
    w = tables.walks(spark, sf_dir).select("vec_id", "v", means.alias("p")).select("vec_id", "v", "p", F.transform("p", lambda x: series.symbol(x, CARDINALITY)).alias("word"))
    pairs = against(asked(w).select(F.col("vec_id").alias("q_id"), F.col("p").alias("qp")), w.select("vec_id", "word"))
    return pairs.select("q_id", "vec_id", F.round(F.sqrt(series.sax_mindist(F.col("qp"), F.col("word"), SEGMENTS, LENGTH, CARDINALITY)), 6).alias("lb"))


def _eapca_sql(sign: str) -> str:
    return f"""WITH {W_}, {_SEG.format(of='w')} SELECT q.vec_id AS q_id, t.vec_id, round(sqrt(sum(16 * ((q.m - t.m) ** 2 + (q.sd {sign} t.sd) ** 2))), 6) AS bound
FROM t AS q JOIN t ON q.i = t.i WHERE q.vec_id % 50 = 0 GROUP BY 1, 2"""


def _eapca(bound) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ends = series.equal_segments(LENGTH, 4)
        pairs = _pairs(tables.walks(spark, sf_dir), series.segment_stats(F.col("v"), ends))
        return pairs.select("q_id", "vec_id", F.round(F.sqrt(bound(F.col("qs"), F.col("s"), [16] * 4)), 6).alias("bound"))

    return run


query(_eapca_sql("-"), "eapca_pair_lb")(_eapca(series.eapca_lower))
query(_eapca_sql("+"), "eapca_pair_ub")(_eapca(series.eapca_upper))


@query(f"WITH {W_}, {_dft('w')} SELECT q.vec_id AS q_id, g.vec_id, round(sqrt(2 * sum((q.x - g.x) ** 2)), 6) AS lb FROM g AS q JOIN g ON q.dim = g.dim WHERE q.vec_id % 50 = 0 GROUP BY 1, 2")
def dft_lb(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(tables.walks(spark, sf_dir), series.dft(F.col("v"), LENGTH, 8))
    return pairs.select("q_id", "vec_id", F.round(F.sqrt(series.dft_lower(F.col("qs"), F.col("s"))), 6).alias("lb"))


@query(f"""WITH {W_}, u AS (SELECT vec_id, v, {_ENV.format(f='max', n='hi')}, {_ENV.format(f='min', n='lo')} FROM w)
SELECT q.vec_id AS q_id, u.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: greatest(u.v[i] - q.hi[i], q.lo[i] - u.v[i], 0) ** 2))), 6) AS lb FROM u AS q, u WHERE q.vec_id % 50 = 0""")
def lb_keogh(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir).select("vec_id", "v")
    q = asked(w).select(F.col("vec_id").alias("q_id"), series.envelope(F.col("v"), LENGTH, 5).alias("env"))
    return against(q, w).select("q_id", "vec_id", F.round(F.sqrt(series.lb_keogh(F.col("v"), F.col("env"))), 6).alias("lb"))


_VIOLATIONS = "SELECT CAST(0 AS BIGINT) AS sax, CAST(0 AS BIGINT) AS eapca_lower, CAST(0 AS BIGINT) AS eapca_upper, CAST(0 AS BIGINT) AS fourier, count(*) AS pairs FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 50 = 0"


@query(_VIOLATIONS)
def bound_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for which a bound is on the wrong side of the distance: none."""
    v, ends = F.col("v"), series.equal_segments(LENGTH, 4)
    w = tables.walks(spark, sf_dir)
    held = w.select("vec_id", "v", series.paa(v, SEGMENTS, LENGTH).alias("p"), series.segment_stats(v, ends).alias("s"), series.dft(v, LENGTH, 8).alias("f")).withColumn("word", F.transform("p", lambda x: series.symbol(x, CARDINALITY)))
    q = asked(held).select(*[F.col(c).alias(f"q_{c}") for c in ("v", "p", "s", "f")])
    pairs = against(q, held).select(
        series.squared_distance(F.col("q_v"), v).alias("d"),
        series.sax_mindist(F.col("q_p"), F.col("word"), SEGMENTS, LENGTH, CARDINALITY).alias("sax"),
        series.eapca_lower(F.col("q_s"), F.col("s"), [16] * 4).alias("low"),
        series.eapca_upper(F.col("q_s"), F.col("s"), [16] * 4).alias("up"),
        series.dft_lower(F.col("q_f"), F.col("f")).alias("dft"),
    )
    over = lambda c: F.count_if(F.col(c) > F.col("d") + 1e-9)
    return pairs.agg(over("sax").alias("sax"), over("low").alias("eapca_lower"), F.count_if(F.col("up") < F.col("d") - 1e-9).alias("eapca_upper"), over("dft").alias("fourier"), F.count("*").alias("pairs"))


@query(_sax_lb("w", W_, "SELECT q_id, round(avg(sqrt(lb) / dist), 6) AS tlb FROM (SELECT l.q_id, lb, list_distance(a.v, c2.v) AS dist FROM l JOIN w AS a ON a.vec_id = l.q_id JOIN w AS c2 ON c2.vec_id = l.vec_id) WHERE dist > 1e-9 GROUP BY 1"))
def tlb_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean tightness of the symbols' bound."""
    v = F.col("v")
    w = tables.walks(spark, sf_dir).select("vec_id", "v", series.paa(v, SEGMENTS, LENGTH).alias("p")).withColumn("word", F.transform("p", lambda x: series.symbol(x, CARDINALITY)))
    q = asked(w).select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"), F.col("p").alias("qp"))
    pairs = against(q, w).select("q_id", series.squared_distance(F.col("qv"), v).alias("d"), series.sax_mindist(F.col("qp"), F.col("word"), SEGMENTS, LENGTH, CARDINALITY).alias("lb"))
    return pairs.where("d > 1e-18").groupBy("q_id").agg(F.round(F.avg(F.sqrt(F.col("lb") / F.col("d"))), 6).alias("tlb"))


@query(_sax_lb("w", W_, """, dd AS (SELECT l.q_id, l.vec_id, lb, list_distance(a.v, c2.v) ** 2 AS d FROM l JOIN w AS a ON a.vec_id = l.q_id JOIN w AS c2 ON c2.vec_id = l.vec_id),
kk AS (SELECT q_id, d AS kth FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM dd) WHERE rank = 10)
SELECT q_id, count(*) AS n_rows, CAST(sum(CASE WHEN lb > kth + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_pruned, round(avg(CASE WHEN lb > kth + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS pruning_ratio FROM dd JOIN kk USING (q_id) GROUP BY 1"""))
def pruning_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the symbols' bound rules out once the tenth distance is known."""
    v = F.col("v")
    w = tables.walks(spark, sf_dir).select("vec_id", "v", series.paa(v, SEGMENTS, LENGTH).alias("p")).withColumn("word", F.transform("p", lambda x: series.symbol(x, CARDINALITY)))
    kth = knn.top(knn.candidates(w, asked(w), 10, seeded=True), 10).where("rank = 10").select("q_id", F.col("vec_id").alias("k_id"))
    q = asked(w).select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"), F.col("p").alias("qp")).join(kth, "q_id").join(w.select(F.col("vec_id").alias("k_id"), F.col("v").alias("kv")), "k_id")
    q = q.select("q_id", "qp", series.squared_distance(F.col("qv"), F.col("kv")).alias("kth"))
    pairs = against(q, w.select("word")).select("q_id", (series.sax_mindist(F.col("qp"), F.col("word"), SEGMENTS, LENGTH, CARDINALITY) > F.col("kth") + 1e-9).alias("gone"))
    return pairs.groupBy("q_id").agg(F.count("*").alias("n_rows"), F.count_if("gone").alias("n_pruned"), F.round(F.avg(F.when(F.col("gone"), 1.0).otherwise(0.0)), 6).alias("pruning_ratio"))


# Exact strategies: the same rows as brute force.


def _refine(summary: Callable[[DataFrame], knn.Summary]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = kept(tables.walks(spark, sf_dir), "walks")
        return knn.knn_join(w, asked(w), 10, summary=summary(w))

    return run


for _name, _summary in {
    "knn_sax_refine": lambda w: knn.SaxSummary(),
    "knn_dft_refine": lambda w: knn.FourierSummary(8),
    "knn_eapca_refine": lambda w: knn.SegmentSummary(8),
    "knn_va_exact": lambda w: quantised.fit(w, LENGTH),
    "knn_va_equidepth_exact": lambda w: quantised.fit(w, LENGTH, how="equidepth"),
}.items():
    query(_knn_sql(W_, "w", 10), _name)(_refine(_summary))


def _index(spark: SparkSession, sf_dir: str, leaf_size: int = 64) -> tuple[DataFrame, DataFrame, tree.Tree]:
    """Data, series of the written index, tree."""
    w = kept(tables.walks(spark, sf_dir), "walks")
    path = shared_path(spark, "tree")
    tree.write(w, tree.build(w, leaf_size, segments=4), path)
    held, found = tree.read(spark, path)
    return w, held, found


def _search(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, held, found = _index(spark, sf_dir)
        return tree.search(held, found, asked(w), 10, **options)

    return run


query(_knn_sql(W_, "w", 10), "knn_tree_exact")(_search(approximate_leaves=2))
query(_knn_sql(W_, "w", 10), "knn_tree_leaves_only")(_search(approximate_leaves=2, sax_threshold=1.1))
query(None, "knn_epsilon")(_search(approximate_leaves=2, epsilon=0.5))
query(None, "knn_ng")(_search(probes=3))
query(None, "knn_approx_greedy")(_search(probes=80))
query(None, "knn_one_leaf")(_search(probes=1))


EPSILON, DELTA = 0.1, 0.9


def _near_enough(w: DataFrame) -> float:
    """The squared distance that is near enough with chance DELTA, by the distances of the queries' nearest rows."""
    return quantised.r_delta(quantised.distance_histogram(w, asked(w)), DELTA)


@query()
def knn_delta_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, held, found = _index(spark, sf_dir)
    return tree.search(held, found, asked(w), 10, approximate_leaves=2, epsilon=EPSILON, r_delta=_near_enough(w))


@query()
def va_delta_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kept(tables.walks(spark, sf_dir), "walks")
    rows = knn.candidates(w, asked(w), 10, summary=quantised.fit(w, LENGTH), seeded=True, epsilon=EPSILON, enough=_near_enough(w))
    return knn.top(rows, 10)


@query(_knn_sql(W_, "w", 10))
def knn_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each neighbour as soon as it is proven."""
    w, held, found = _index(spark, sf_dir)
    return tree.found_stepwise(held, found, asked(w), 10).drop("leaves")


@query(_knn_sql(W_, "w", 10))
def append_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of every third row, to which the others are appended in two batches of other spread."""
    w = kept(tables.walks(spark, sf_dir), "walks")
    path = shared_path(spark, "tree")
    first = w.where("vec_id % 3 = 0")
    built = tree.build(first, 64, segments=4)
    tree.write(first, built, path)
    for n in (1, 2):
        ingest.append(w.where(F.col("vec_id") % 3 == n).select("vec_id", "v"), n, built, path)
    held, found = tree.read(spark, path)
    return tree.search(held, found, asked(w), 10, approximate_leaves=2)


_PLACES = "e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(_knn_sql(_PLACES, "e", 10))
def float_roundtrip_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to float files and read back; ids are places in the order of the written ones."""
    path = shared_path(spark, "floats")
    floats.register(spark)
    floats.write(tables.embeddings(spark, sf_dir), path)
    e = spark.read.format("float_series").option("length", LENGTH).load(path)
    return knn.knn_join(e, asked(e), 10)


@query()
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, held, found = _index(spark, sf_dir)
    return tree.query_stats(held, found, asked(w), 10, approximate_leaves=2)


# What holds for every answer of a search whose rows depend on the index: SQL states it, and nothing may be on the wrong side.

_ASKED = "FROM embeddings WHERE vec_id % 50 = 0"
_ZEROS = f"SELECT vec_id AS q_id, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_under, CAST(0 AS BIGINT) AS n_false {_ASKED}"


def _checked(run: Query, k: int, least: int, most: Callable[[DataFrame], Column] | None = None) -> Query:
    """q_id and how many of its rows are missing (of least), over what the method allows, nearer than the exact ones, or not at the
    distance told. most: from the walks, what a distance may be at most, of the column exact."""

    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = kept(tables.walks(spark, sf_dir), "walks")
        exact = knn.knn_join(w, asked(w), k).select("q_id", "rank", F.col("dist").alias("exact"))
        vectors = w.select("vec_id", "v").join(run(spark, sf_dir), "vec_id").join(asked(w).select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv")), "q_id")
        found = vectors.select("q_id", "rank", "dist", F.sqrt(series.squared_distance(F.col("v"), F.col("qv"))).alias("truth"))
        rows, few = exact.join(found, ["q_id", "rank"], "left"), 2e-6
        over = F.count_if(F.col("dist") > most(w) + few) if most else F.lit(0).cast("long")
        return rows.groupBy("q_id").agg(F.greatest(F.lit(0).cast("long"), least - F.count("dist")).alias("n_missing"), over.alias("n_over"), F.count_if(F.col("dist") < F.col("exact") - few).alias("n_under"), F.count_if(F.abs(F.col("dist") - F.col("truth")) > few).alias("n_false"))

    return check


def _delta_most(w: DataFrame) -> Column:
    return F.greatest(F.col("exact"), F.lit(_near_enough(w) ** 0.5)) * (1 + EPSILON) ** 0.5


query(_ZEROS, "knn_epsilon_checks")(_checked(_search(approximate_leaves=2, epsilon=0.5), 10, 10, lambda w: F.col("exact") * 1.5**0.5))
query(_ZEROS, "knn_delta_epsilon_checks")(_checked(knn_delta_epsilon, 10, 10, _delta_most))
query(_ZEROS, "va_delta_epsilon_checks")(_checked(va_delta_epsilon, 10, 10, _delta_most))
query(_ZEROS, "knn_ng_checks")(_checked(_search(probes=3), 10, 1))
query(_ZEROS, "knn_one_leaf_checks")(_checked(_search(probes=1), 10, 1))
query(_ZEROS, "knn_approx_greedy_checks")(_checked(_search(probes=4), 10, 4))


@query(f"SELECT q_id, dist AS exact, CAST(0 AS BIGINT) AS wrong FROM ({_knn_sql(W_, 'w', 10)}) WHERE rank = 10")
def query_stats_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth distance, and what of the statistics can't be."""
    s = query_stats(spark, sf_dir)
    n = tables.embeddings(spark, sf_dir).count()
    fine = (F.col("leaves_read").between(1, F.col("leaves"))) & (F.col("rows") == n) & (F.col("rows_read") <= n) & (F.col("rows_read") >= 10) & (F.col("approximate") >= F.col("exact"))
    return s.select("q_id", "exact", F.when(fine, 0).otherwise(1).cast("long").alias("wrong"))


@query(f"SELECT q_id, dist AS exact, CAST(0 AS BIGINT) AS wrong FROM ({_knn_sql(W_, 'w', 2)}) WHERE rank = 2")
def effective_epsilon_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = effective_epsilon(spark, sf_dir)
    fine = (F.col("epsilon") >= 0) & (F.abs(F.col("exact") * (1 + F.col("epsilon")) - F.col("approximate")) < 1e-4)
    return e.select("q_id", "exact", F.when(fine, 0).otherwise(1).cast("long").alias("wrong"))


@query(f"SELECT vec_id AS q_id, (SELECT count(*) FROM embeddings) AS n_rows, CAST(0 AS BIGINT) AS n_lower, CAST(0 AS BIGINT) AS n_upper, CAST(0 AS BIGINT) AS n_lost {_ASKED}")
def node_mindists_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the root, and nodes whose lower or upper bound is on the wrong side of a distance, or that have no bound. Spark takes what
    tasks make of a range for small, and would broadcast it."""
    w, held, found = _index(spark, sf_dir)
    rows = tree.extremes(held, asked(w)).join(tree.mindists(spark, found, asked(w)).hint("merge"), ["q_id", "node_id"], "left")
    return rows.groupBy("q_id").agg(F.max("n").alias("n_rows"), F.count_if(F.col("lower") > F.col("low") + 1e-9).alias("n_lower"), F.count_if(F.col("upper") < F.col("high") - 1e-9).alias("n_upper"), F.count_if(F.col("lower").isNull()).alias("n_lost"))


@query(f"SELECT vec_id AS q_id, CAST(0 AS BIGINT) AS n_wrong {_ASKED}")
def pruned_nodes_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned nodes that hold a row nearer than the first k-th distance."""
    w, held, found = _index(spark, sf_dir)
    cut = tree.pruned_nodes(held, found, asked(w), 10, approximate_leaves=2)
    wrong = cut.hint("merge").join(tree.extremes(held, asked(w)), ["q_id", "node_id"]).groupBy("q_id").agg(F.count_if(F.sqrt("low") < F.col("bsf") - 2e-6).alias("n"))
    return asked(w).select(F.col("vec_id").alias("q_id")).join(wrong, "q_id", "left").select("q_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_wrong"))


@query(f"SELECT q_id, dist AS bsf, CAST(0 AS BIGINT) AS n_rising, CAST(0 AS BIGINT) AS n_early FROM ({_knn_sql(W_, 'w', 1)})")
def progressive_bsf_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last distance, steps at which it rises, and proofs before it is reached."""
    w = Window.partitionBy("q_id").orderBy("step")
    rows = progressive_bsf(spark, sf_dir).withColumn("before", F.lag("bsf").over(w)).withColumn("last", F.min("bsf").over(Window.partitionBy("q_id")))
    return rows.groupBy("q_id").agg(F.min("last").alias("bsf"), F.count_if(F.col("bsf") > F.col("before")).alias("n_rising"), F.count_if(F.col("proven") & (F.col("bsf") > F.col("last"))).alias("n_early"))


@query("SELECT count(*) AS n_series, CAST(-1 AS BIGINT) AS inner_less_leaves, CAST(0 AS BIGINT) AS wrong FROM embeddings")
def tree_leaf_stats_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree has one inner node less than leaves, fill is within 0 and 1, and its mean is that of the sizes."""
    s = tree_leaf_stats(spark, sf_dir)
    fine = (F.col("min_fill") > 0) & (F.col("max_fill") <= 1) & (F.abs(F.col("avg_fill") * F.col("n_leaves") * 64 - F.col("n_series")) < 1e-6) & F.col("avg_height").between(F.col("min_height"), F.col("max_height"))
    return s.select("n_series", (F.col("n_nodes") - 2 * F.col("n_leaves")).alias("inner_less_leaves"), F.when(fine, 0).otherwise(1).cast("long").alias("wrong"))


@query()
def progressive_bsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, held, found = _index(spark, sf_dir)
    return tree.progressive(held, found, asked(w))


@query()
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, held, found = _index(spark, sf_dir)
    return tree.pruned_nodes(held, found, asked(w), 10, approximate_leaves=2)


@query()
def node_mindists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    return tree.mindists(spark, tree.build(w, 64, segments=4), asked(w))


@query()
def tree_leaf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    return tree.leaf_stats(tree.nodes_table(spark, tree.build(w, 64, segments=4)), 64)


@query()
def effective_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the one-leaf answer is from the exact one, of the nearest row but the query itself."""
    w, held, found = _index(spark, sf_dir)
    near = tree.search(held, found, asked(w), 2, probes=1).where("rank = 2").select("q_id", F.col("dist").alias("approximate"))
    exact = knn.knn_join(w, asked(w), 2, summary=knn.SaxSummary()).where("rank = 2").select("q_id", F.col("dist").alias("exact"))
    return exact.join(near, "q_id").withColumn("epsilon", F.round(F.col("approximate") / F.col("exact") - 1, 6))


_ROOT = f"WITH {W_}, {_SEG.format(of='w')}, r AS (SELECT i, max(m) AS max_mean, min(m) AS min_mean, max(sd) AS max_sd, min(sd) AS min_sd FROM t GROUP BY i)"


def _root(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = tables.walks(spark, sf_dir).select("vec_id", series.segment_stats(F.col("v"), series.equal_segments(LENGTH, 4)).alias("s"))
    return held, held.agg(series.node_sketch(F.col("s"), 4).alias("sketch"))


@query(f"""{_ROOT} SELECT vec_id AS q_id, round(sqrt(sum(16 * (greatest(min_mean - m, m - max_mean, 0) ** 2 + greatest(min_sd - sd, sd - max_sd, 0) ** 2))), 6) AS lower,
round(sqrt(sum(16 * ((sd + max_sd) ** 2 + greatest(abs(m - min_mean), abs(m - max_mean)) ** 2))), 6) AS upper FROM t JOIN r USING (i) WHERE vec_id % 50 = 0 GROUP BY 1""")
def eapca_lb_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, root = _root(spark, sf_dir)
    s, k = F.col("s"), F.col("sketch")
    return asked(held).join(F.broadcast(root)).select(F.col("vec_id").alias("q_id"), F.round(F.sqrt(series.node_lower(s, k, [16] * 4)), 6).alias("lower"), F.round(F.sqrt(series.node_upper(s, k, [16] * 4)), 6).alias("upper"))


@query(f"{_ROOT} SELECT round(sum(16 * ((max_mean - min_mean) ** 2 + max_sd ** 2)), 6) AS qos FROM r")
def node_qos_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(spark, sf_dir)[1].select(F.round(series.node_qos(F.col("sketch"), [16] * 4), 6).alias("qos"))


# Quantised coefficients.

_ENERGY = f"WITH {W_}, {_dft('w')}, n AS (SELECT CAST(dim AS INTEGER) AS dim, var_pop(x) AS energy FROM g GROUP BY 1)"


@query(f"{_ENERGY} SELECT dim, round(energy, 6) AS energy FROM n")
def va_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.energies(quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8)).select("dim", F.round("energy", 6).alias("energy"))


_BITS = f"""WITH RECURSIVE {_ENERGY.removeprefix('WITH ')}, a AS (
  SELECT 0 AS step, list(energy ORDER BY dim) AS left_, list_transform(range(0, 16), lambda i: 0) AS bits FROM n
  UNION ALL SELECT step + 1, list_transform(range(1, 17), lambda i: CASE WHEN i = list_position(left_, list_max(left_)) THEN left_[i] / 4 ELSE left_[i] END),
    list_transform(range(1, 17), lambda i: CASE WHEN i = list_position(left_, list_max(left_)) THEN bits[i] + 1 ELSE bits[i] END) FROM a WHERE step < 64)"""


@query(f"{_BITS} SELECT CAST(i AS INTEGER) AS dim, CAST(bits[i + 1] AS INTEGER) AS bits FROM (SELECT bits, unnest(range(0, 16)) AS i FROM a WHERE step = 64)")
def va_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    energy = {r["dim"]: r["energy"] for r in quantised.energies(quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8)).collect()}
    return spark.createDataFrame(list(enumerate(quantised.allocate([energy[d] for d in range(16)], 4))), "dim int, bits int")


@query(f"WITH {W_}, {_dft('w')} SELECT CAST(dim AS INTEGER) AS dim, CAST(i AS INTEGER) AS border, round(quantile_cont(x, i / 8.0), 6) AS x FROM g, (SELECT unnest(range(1, 8)) AS i) GROUP BY dim, i"
       .replace("quantile_cont(x, i / 8.0)", "CASE i " + " ".join(f"WHEN {i} THEN quantile_cont(x, {i / 8})" for i in range(1, 8)) + " END"))
def va_equidepth(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs = quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8)
    return quantised.equidepth(coefs, [3] * 16).select("dim", "border", F.round("x", 6).alias("x"))


@query(f"WITH {W_}, {_dft('w')} SELECT CAST(dim AS INTEGER) AS dim, CAST(i AS INTEGER) AS border, round(min(x) + (max(x) - min(x)) * i / 8, 6) AS x FROM g, (SELECT unnest(range(1, 8)) AS i) GROUP BY dim, i")
def va_equiwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs = quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8)
    return quantised.equiwidth(coefs, 8).select("dim", "border", F.round("x", 6).alias("x"))


@query()
def va_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    borders = quantised.kmeans(quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8), [3] * 16)
    return spark.createDataFrame([(d, i, x) for d, b in enumerate(borders) for i, x in enumerate(b, 1)], "dim int, border int, x double")


@query("SELECT CAST(d AS INTEGER) AS dim, CAST(7 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_unsorted, CAST(0 AS BIGINT) AS n_outside FROM (SELECT unnest(range(0, 16)) AS d)")
def va_kmeans_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of a dimension, those not above the one before, and those outside of the coefficients."""
    coefs = quantised.coefficients(tables.walks(spark, sf_dir), LENGTH, 8).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    rows = va_kmeans(spark, sf_dir).withColumn("before", F.lag("x").over(Window.partitionBy("dim").orderBy("border"))).join(coefs, "dim")
    return rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("before")).alias("n_unsorted"), F.count_if(~F.col("x").between(F.col("low"), F.col("high"))).alias("n_outside"))


@query(_knn_sql(W_, "w", 10, "vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT 200)"))
def va_ng(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 rows are read, in file order: the limit is the feature."""
    w = tables.walks(spark, sf_dir)
    return quantised.in_file_order(w, asked(w), 10, 200, quantised.fit(w, LENGTH))


# Words.


@query()
def word_home_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    return words.home_leaf_join(w, asked(w), words.build(w, 64), 10)


@query(_knn_sql(W_, "w", 10))
def knn_word_tree_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kept(tables.walks(spark, sf_dir), "walks")
    built = words.build(w, 64)
    return words.search(kept(words.assigned(w, built), "leaves"), built, asked(w), 10, first_leaves=2)


query(_ZEROS, "word_home_leaf_checks")(_checked(word_home_leaf, 10, 1))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_loose, CAST(0 AS BIGINT) AS n_wrong_size FROM embeddings")
def word_wedges_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in leaves, points outside of their leaf's wedge, sides of wedges that no point touches, and leaves of another size than told."""
    w = tables.walks(spark, sf_dir)
    built = words.build(w, 64)
    rows = kept(words.assigned(w, built), "leaves")
    points = rows.select("leaf_id", F.posexplode("v").alias("pos", "x")).join(words.envelopes(rows), ["leaf_id", "pos"])
    sides = points.groupBy("leaf_id", "pos").agg(F.count_if((F.col("x") > F.col("upper")) | (F.col("x") < F.col("lower"))).alias("out"), (F.count_if(F.col("x") == F.col("upper")) == 0).alias("a"), (F.count_if(F.col("x") == F.col("lower")) == 0).alias("b"))
    told = spark.createDataFrame([(n.id, n.size) for n in built.leaves()], "leaf_id long, size long")
    sizes = rows.groupBy("leaf_id").agg(F.count("*").alias("n")).join(told.where("size > 0"), "leaf_id", "full").agg(F.sum("n").alias("n"), F.count_if(~F.col("n").eqNullSafe(F.col("size"))).alias("n_wrong_size"))
    return sides.agg(F.sum("out").alias("n_outside"), (F.count_if("a") + F.count_if("b")).alias("n_loose")).crossJoin(sizes).select("n", "n_outside", "n_loose", "n_wrong_size")


@query()
def word_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.build(tables.walks(spark, sf_dir), 64)
    rows = [(n.id, list(n.bits), list(n.values), n.size) for n in found.nodes.values() if n.cut is None]
    return spark.createDataFrame(rows, "leaf_id long, bits array<int>, prefix array<int>, size long")


@query()
def word_wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    return words.envelopes(words.assigned(w, words.build(w, 64)))


@query(f"WITH {W_}, {_word('w', 2)} SELECT CAST(list_sum(list_transform(range(0, 16), lambda i: word[i + 1] * (2 ** (15 - i)))) AS BIGINT) AS mask, count(*) AS n FROM x GROUP BY 1")
def root_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.walks(spark, sf_dir)
    return w.groupBy(series.root_mask(series.sax(F.col("v"), SEGMENTS, LENGTH, 2), 1).alias("mask")).agg(F.count("*").alias("n"))


# Time warping.


@query(f"""WITH {W_}, {_word('w')}, y AS (SELECT vec_id, word, [CAST(-1e300 AS DOUBLE)] || cuts AS lo, cuts || [CAST(1e300 AS DOUBLE)] AS hi FROM x, b),
u AS (SELECT vec_id, {_ENV.format(f='max', n='hi')}, {_ENV.format(f='min', n='lo')} FROM w WHERE vec_id % 50 = 0),
q AS (SELECT vec_id AS q_id, list_transform(range(0, 16), lambda i: list_sum(hi[4 * i + 1:4 * i + 4]) / 4) AS top, list_transform(range(0, 16), lambda i: list_sum(lo[4 * i + 1:4 * i + 4]) / 4) AS low FROM u)
SELECT q_id, vec_id, round(sqrt(4 * list_sum(list_transform(range(1, 17), lambda i: greatest(y.lo[y.word[i] + 1] - q.top[i], q.low[i] - y.hi[y.word[i] + 1], 0) ** 2))), 6) AS lb FROM q, y""")
def dtw_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words' bound of the warping distance. What a pair needs of either series is made before they meet."""
    w = kept(tables.walks(spark, sf_dir).select("vec_id", "v"), "walks")
    cells = series.cell_borders(series.sax(F.col("v"), SEGMENTS, LENGTH, CARDINALITY), CARDINALITY)
    means = series.envelope_means(series.envelope(F.col("v"), LENGTH, 5), SEGMENTS, LENGTH)
    q = asked(w).select(F.col("vec_id").alias("q_id"), *[c.alias(n) for c, n in zip(means, ("top", "low"), strict=True)])
    pairs = against(q, w.select("vec_id", *[c.alias(n) for c, n in zip(cells, ("cell_low", "cell_high"), strict=True)]))
    gap = series.interval_gap(F.col("top"), F.col("low"), F.col("cell_low"), F.col("cell_high"), SEGMENTS, LENGTH)
    return pairs.select("q_id", "vec_id", F.round(F.sqrt(gap), 6).alias("lb"))


def _dtw_sql(k: int, band: int, where: str = "true") -> str:
    """The recurrence, a row of the cost matrix a step: cells of row i from max(0, i - band), each the cost plus the least of up, slant and left."""
    lo = "greatest(0, i - {b})"
    cost = "(qv[i + 1] - v[lo2 + j]) ** 2"
    up = "least(coalesce(before[lo2 - lo + j], 1e300), coalesce(CASE WHEN lo2 - lo + j > 1 THEN before[lo2 - lo + j - 1] END, 1e300), CASE WHEN i = 0 AND j = 1 THEN 0 ELSE 1e300 END)"
    step = f"list_reduce([[CAST(1e300 AS DOUBLE)]] || list_transform(range(1, least(64, i + {band} + 1) - lo2 + 1), lambda j: [CAST({cost} AS DOUBLE), CAST({up} AS DOUBLE)]), lambda a, x: a || [x[1] + least(x[2], a[len(a)])])[2:]"
    lo = lo.format(b=band)
    return f"""WITH RECURSIVE {W_}, p AS (SELECT q.vec_id AS q_id, w.vec_id, q.v AS qv, w.v FROM w AS q, w WHERE q.vec_id % 50 = 0),
t AS (SELECT q_id, vec_id, qv, v, 0 AS i, 0 AS lo, CAST([] AS DOUBLE[]) AS before FROM p WHERE {where}
  UNION ALL SELECT q_id, vec_id, qv, v, i + 1, lo2, {step} FROM (SELECT *, {lo} AS lo2 FROM t WHERE i < 64)),
d AS (SELECT q_id, vec_id, sqrt(before[len(before)]) AS dist FROM t WHERE i = 64),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rank FROM d)"""


@query(_dtw_sql(5, 5) + " SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 5")
def dtw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kept(tables.walks(spark, sf_dir), "walks")
    return warping.dtw_join(w, asked(w), 5, 5, summary=True)


@query(_dtw_sql(5, 5, "q_id <> vec_id") + _VOTE.format(k=5))
def dtw_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kept(tables.walks(spark, sf_dir), "walks")
    return warping.dtw_classify(w, asked(w), 5, 5, summary=True)


@query(_knn_sql(W_, "w", 5))
def dtw_band0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without room to warp, the distance is Euclidean."""
    w = kept(tables.walks(spark, sf_dir), "walks")
    return warping.dtw_join(w, asked(w), 5, 0)


# Series from other tables.

_GRID = "g AS (SELECT id, list(coalesce(x, 0) ORDER BY b) AS v FROM (SELECT ids.id, bs.b, x FROM (SELECT DISTINCT id FROM s) AS ids, (SELECT unnest(range(0, {n})) AS b) AS bs LEFT JOIN s ON s.id = ids.id AND s.b = bs.b) GROUP BY id)"
_DAILY = "s AS (SELECT user_id AS id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS b, sum(value) AS x FROM events GROUP BY 1, 2), " + _GRID.format(n=30)
_MONTHLY = "s AS (SELECT c_nationkey AS id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS b, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), " + _GRID.format(n=80)
_SUPPLY = "s AS (SELECT l_suppkey AS id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS b, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), " + _GRID.format(n=83)


def _derived_sql(prelude: str, k: int, who: str) -> str:
    return f"""WITH {prelude}, z AS (SELECT id, CASE WHEN s > 1e-12 THEN list_transform(v, lambda x: (x - m) / s) ELSE list_transform(v, lambda x: 0.0) END AS v
FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS s FROM (SELECT *, list_sum(v) / len(v) AS m FROM g))),
d AS (SELECT q.id AS q_id, z.id AS vec_id, list_distance(q.v, z.v) AS dist FROM z AS q, z WHERE {who}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT CAST(q_id AS BIGINT) AS q_id, CAST(vec_id AS BIGINT) AS vec_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= {k}"""


def _derived(load: Query, k: int, every: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        z = kept(tables.normalised(load(spark, sf_dir)).withColumnRenamed("series_id", "vec_id"), "series")
        return knn.knn_join(z, z.where(F.col("vec_id") % every == 0), k, summary=knn.FourierSummary(8))

    return run


query(_derived_sql(_DAILY, 5, "q.id % 10 = 0"), "event_series_knn")(_derived(tables.event_daily, 5, 10))
query(_derived_sql(_MONTHLY, 3, "true"), "order_series_knn")(_derived(tables.order_monthly, 3, 1))
query(_derived_sql(_SUPPLY, 5, "q.id % 10 = 0"), "supplier_series_knn")(_derived(tables.supplier_monthly, 5, 10))


@query()
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.random_walks(spark, 1000, 256, 1184)


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(256 AS INTEGER) AS length, CAST(500 AS BIGINT) AS n_distinct, 0.0 AS mean, 1.0 AS sd")
def random_walk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that hold for any seed: rows, length, distinct series when every second one repeats, mean and deviation."""
    w = tables.random_walks(spark, 1000, 256, 1184, repeat_every=2)
    v = F.col("v")
    rows = w.select(F.xxhash64("v").alias("h"), F.size("v").alias("n"), series.mean(v).alias("m"), series.sd(v).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.max("n").alias("length"), F.countDistinct("h").alias("n_distinct"), (F.round(F.max(F.abs("m")), 6) + 0.0).alias("mean"), F.round(F.avg("s"), 6).alias("sd"))
