"""The k nearest series of each query: brute force, and filter-and-refine with lower bounds.

Distances are first told by a matrix product of a batch and the queries, with a bound of its error; differences, which don't cancel, are
taken for the few rows that may be among the nearest.

A scan runs over the data once for a block of queries. The block goes to the workers; its size is checked, and a larger query table is taken
in blocks, one after another, so that nothing broadcast grows with the data. Every task keeps the k best of each query so far and tightens
its bound as it reads, and only these leave it; a window then keeps the k best of all. With a summary, rows whose lower bound passes the
bound are never compared.

Null ids and vectors take no part. They are left out in the workers: a filter on a derived vector would be pushed below the expression that
makes it, and evaluate it twice.

Ties go to the smaller id. Distances are Euclidean, found in double precision as sums of squared differences and reported as roots.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays

#: Numbers of the query table that are broadcast at once (8 bytes each).
BLOCK_NUMBERS = 4_000_000
FOUND = pa.schema([("q_id", pa.int64()), ("vec_id", pa.int64()), ("d2", pa.float64()), ("n", pa.int64())])
#: Queries that meet a batch in one matrix product.
TILE = 256
#: Rows that a first bound is found on.
SEED_ROWS = 1024

Queries = tuple[np.ndarray, np.ndarray]


class Summary(Protocol):
    """A way to bound squared distances from below."""

    def of(self, x: np.ndarray) -> object:
        """Summaries of the rows of x."""

    def lower(self, q: np.ndarray, held: object) -> np.ndarray:
        """Lower bounds of the squared distances of the series q to the rows summarised."""


class SaxSummary:
    """Symbols of segment means."""

    def __init__(self, segments: int = 16, cardinality: int = 256):
        self.segments, self.cardinality = segments, cardinality
        cuts = np.array(arrays.breakpoints(cardinality))
        self.low, self.high = np.r_[-np.inf, cuts], np.r_[cuts, np.inf]

    def of(self, x: np.ndarray) -> np.ndarray:
        return arrays.symbols(arrays.paa(x, self.segments), self.cardinality)

    def lower(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        means = arrays.paa(q[None], self.segments)[0]
        gaps = np.maximum(0, np.maximum(self.low - means[:, None], means[:, None] - self.high)) ** 2  # segment x symbol
        return (len(q) // self.segments) * gaps[np.arange(self.segments), held].sum(axis=1)


class FourierSummary:
    """The first Fourier coefficients without frequency 0."""

    def __init__(self, coefficients: int = 8):
        self.coefficients = coefficients

    def of(self, x: np.ndarray) -> np.ndarray:
        return arrays.spectrum(x, min(self.coefficients, (x.shape[1] - 1) // 2))

    def lower(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        return 2 * arrays.squared_distances(held, self.of(q[None])[0])

    def lower_all(self, qs: np.ndarray, held: np.ndarray) -> np.ndarray:
        d, wrong = arrays.products(held, self.of(qs))
        return 2 * (d - wrong[:, None])


class SegmentSummary:
    """Mean and deviation of equal segments."""

    def __init__(self, segments: int = 8):
        self.segments = segments

    def _ends(self, n: int) -> list[int]:
        step = n // self.segments
        return [step * (i + 1) for i in range(self.segments - 1)] + [n]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = self._ends(x.shape[1])
        return (*arrays.segment_stats(x, ends), np.diff([0, *ends]))

    def lower(self, q: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        means, sds, lengths = held
        m, s, _ = self.of(q[None])
        return (((means - m) ** 2 + (sds - s) ** 2) * lengths).sum(axis=1)


def query_blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[Queries]:
    """Ids and vectors of the queries, a bounded block at a time."""
    rows = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ids, vectors, held = [], [], 0
    for r in rows.repartition(8).toLocalIterator():  # the shuffle lets the scan for the queries run in parallel
        if r["id"] is None or r["v"] is None:
            continue
        ids.append(r["id"])
        vectors.append(r["v"])
        held += len(r["v"])
        if held >= BLOCK_NUMBERS:
            yield np.array(ids), np.array(vectors)
            ids, vectors, held = [], [], 0
    if ids:
        yield np.array(ids), np.array(vectors)


class Best:
    """The k least distances of one query so far, ties by id."""

    def __init__(self, k: int, bound: float = np.inf):
        self.k, self.bound = k, bound
        self.d, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def limit(self, epsilon: float, enough: float) -> float:
        """What a lower bound may be at most."""
        if len(self.d) < self.k or not (epsilon or enough):
            return self.bound
        return -1.0 if self.d[-1] <= enough * (1 + epsilon) else min(self.bound, self.d[-1] / (1 + epsilon))

    def offer(self, d: np.ndarray, ids: np.ndarray) -> None:
        near = d <= self.bound
        if near.any():
            d, ids = np.r_[self.d, d[near]], np.r_[self.ids, ids[near]]
            order = np.lexsort((ids, d))[: self.k]
            self.d, self.ids = d[order], ids[order]
            if len(self.d) == self.k:
                self.bound = min(self.bound, self.d[-1])


def offer_near(best: list[Best], x: np.ndarray, ids: np.ndarray, qs: np.ndarray, live: np.ndarray | None = None) -> None:
    """Offers each query the rows of x that may be among its nearest; live: queries x rows that count."""
    for at in range(0, len(qs), TILE):
        some = slice(at, at + TILE)
        d, wrong = arrays.products(x, qs[some])
        if live is not None:
            d[~live[some]] = np.inf
        for i, b in enumerate(best[some]):
            near = np.flatnonzero(d[i] <= b.bound + wrong[i])
            if len(near) > 4 * b.k:
                kth = np.partition(d[i, near], b.k - 1)[b.k - 1]
                near = near[d[i, near] <= kth + 2 * wrong[i]]
            near = near[np.isfinite(d[i, near])]
            if len(near):
                b.offer(arrays.squared_distances(x[near], qs[at + i]), ids[near])


def scan(data: DataFrame, block: Queries, k: int, *, id_col: str, vector_col: str, summary: Summary | None = None, exclude_self: bool = False, radius: float | None = None, bounds: np.ndarray | None = None, offer=offer_near, epsilon: float = 0.0, enough: float = 0.0) -> DataFrame:
    """One pass over data for a block of queries: q_id, vec_id, d2, and for each task and query a row with vec_id null, d2 the rows compared and
    n the rows seen. radius: all rows nearer than that instead of k. bounds: what the k-th squared distance of each query can't pass.
    offer: as offer_near, for distances that aren't Euclidean. epsilon: rows are ruled out by the k-th distance so far over 1 + epsilon
    (squared). enough: a task looks no further for a query whose k-th squared distance is within (1 + epsilon) times that."""
    shared = data.sparkSession.sparkContext.broadcast((block, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in scanned(batches):
            yield pa.RecordBatch.from_pandas(found, schema=FOUND, preserve_index=False)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        (q_ids, qs), limits = shared.value
        best = [Best(k, np.inf if limits is None else float(limits[i]) * (1 + 1e-12) + 1e-12) for i in range(len(q_ids))]
        seen, compared = 0, np.zeros(len(q_ids), np.int64)
        found = []
        for batch in batches:
            x, ids = arrays.matrix(batch, "v", "id")
            if not len(ids):
                continue
            seen += len(ids)
            held = summary.of(x) if summary else None
            if radius is None:
                for at in range(0, len(qs), TILE):
                    some, live = slice(at, at + TILE), None
                    if summary or exclude_self:
                        limits_now = np.array([b.limit(epsilon, enough) for b in best[some]])
                        live = np.ones((len(limits_now), len(ids)), bool) if not summary else lowers(summary, qs[some], held) <= limits_now[:, None] + 1e-9
                        if exclude_self:
                            live &= ids != q_ids[some, None]
                    compared[some] += len(ids) if live is None else live.sum(axis=1)
                    offer(best[some], x, ids, qs[some], live)
                continue
            for i, q in enumerate(qs):
                live = np.flatnonzero(summary.lower(q, held) <= radius * radius + 1e-9) if summary else np.arange(len(ids))
                if exclude_self:
                    live = live[ids[live] != q_ids[i]]
                compared[i] += len(live)
                d = arrays.squared_distances(x[live] if len(live) < len(ids) else x, q)
                near = d < radius * radius
                found.append(pd.DataFrame({"q_id": q_ids[i], "vec_id": ids[live[near]], "d2": d[near], "n": 0}))
            if found:
                yield pd.concat(found).astype({"vec_id": "Int64"})
                found = []
        if radius is None:
            for i, b in enumerate(best):
                yield pd.DataFrame({"q_id": q_ids[i], "vec_id": b.ids, "d2": b.d, "n": 0}).astype({"vec_id": "Int64"})
        yield pd.DataFrame({"q_id": q_ids, "vec_id": pd.array([None] * len(q_ids), "Int64"), "d2": compared.astype(float), "n": seen})

    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "q_id long, vec_id long, d2 double, n long")


def lowers(summary: Summary, qs: np.ndarray, held: object) -> np.ndarray:
    """Lower bounds, queries x rows, at once where the summary has a way."""
    if hasattr(summary, "lower_all"):
        return summary.lower_all(qs, held)
    return np.stack([summary.lower(q, held) for q in qs]) if len(qs) else np.zeros((0, 0))


def seeds(data: DataFrame, block: Queries, k: int, *, id_col: str, vector_col: str, exclude_self: bool = False) -> np.ndarray:
    """For each query the k-th least squared distance to a few rows: no k-th distance over all rows is larger."""
    rows = data.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).limit(max(SEED_ROWS, 4 * k)).toPandas().dropna()
    out = np.full(len(block[0]), np.inf)
    if len(rows):
        x, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
        for i, q in enumerate(block[1]):
            d = np.sort(arrays.squared_distances(x, q)[ids != block[0][i] if exclude_self else slice(None)])
            if len(d) >= k:
                out[i] = d[k - 1]
    return out


def _union(parts: list[DataFrame], data: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else data.sparkSession.createDataFrame([], "q_id long, vec_id long, d2 double, n long")


def candidates(data: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "v", q_id_col: str = "vec_id", q_vector_col: str = "v", summary: Summary | None = None, exclude_self: bool = False, seeded: bool = False, epsilon: float = 0.0, enough: float = 0.0) -> DataFrame:
    """The tasks' rows of all query blocks."""
    parts = []
    for block in query_blocks(queries, q_id_col, q_vector_col):
        bounds = seeds(data, block, k, id_col=id_col, vector_col=vector_col, exclude_self=exclude_self) if seeded else None
        parts.append(scan(data, block, k, id_col=id_col, vector_col=vector_col, summary=summary, exclude_self=exclude_self, bounds=bounds, epsilon=epsilon, enough=enough))
    return _union(parts, data)


def top(found: DataFrame, k: int, *, distinct: bool = False) -> DataFrame:
    """q_id, vec_id, rank, dist of the k least; distinct: of the k least different distances, each with its smallest id."""
    rows = found.where(F.col("vec_id").isNotNull())
    if distinct:
        rows = rows.groupBy("q_id", F.round("d2", 12).alias("d2")).agg(F.min("vec_id").alias("vec_id"))
    w = Window.partitionBy("q_id").orderBy("d2", "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "vec_id", "rank", F.round(F.sqrt("d2"), 6).alias("dist"))


def knn_join(data: DataFrame, queries: DataFrame, k: int, *, summary: Summary | None = None, distinct: bool = False, exclude_self: bool = False, keep=None, **columns_) -> DataFrame:
    """q_id, vec_id, rank, dist. summary: None compares every row; any summary gives the same rows. keep: (table, name) -> the table, written."""
    if not distinct:
        return top(candidates(data, queries, k, summary=summary, exclude_self=exclude_self, seeded=summary is not None, **columns_), k)
    # Fewer rows than distances can hide behind ties, so all rows of the k least distances are looked for with a growing k.
    take = 2 * k
    while True:
        found = candidates(data, queries, take, summary=summary, exclude_self=exclude_self, seeded=summary is not None, **columns_)
        if keep is not None:
            found = keep(found, "distinct")  # read twice
        got = top(found, k, distinct=True)
        full = found.where("vec_id IS NOT NULL").groupBy("q_id").agg(F.countDistinct(F.round("d2", 12)).alias("n"), F.count("*").alias("m"))
        if full.where((F.col("n") < k) & (F.col("m") >= take)).isEmpty():
            return got
        take *= 4


def range_search(data: DataFrame, queries: DataFrame, radius: float, *, id_col: str = "vec_id", vector_col: str = "v", q_id_col: str = "vec_id", q_vector_col: str = "v", summary: Summary | None = None) -> DataFrame:
    """q_id, vec_id, dist of all rows nearer than radius."""
    parts = [scan(data, b, 0, id_col=id_col, vector_col=vector_col, summary=summary, radius=radius) for b in query_blocks(queries, q_id_col, q_vector_col)]
    return _union(parts, data).where(F.col("vec_id").isNotNull()).select("q_id", "vec_id", F.round(F.sqrt("d2"), 6).alias("dist"))


def pruning(data: DataFrame, queries: DataFrame, k: int, summary: Summary, **columns_) -> DataFrame:
    """q_id, n_rows, n_compared, pruning_ratio of a filtered search."""
    rows = candidates(data, queries, k, summary=summary, seeded=True, **columns_).where("vec_id IS NULL")
    return rows.groupBy("q_id").agg(F.sum("n").alias("n_rows"), F.sum("d2").cast("long").alias("n_compared")).withColumn("pruning_ratio", 1 - F.col("n_compared") / F.col("n_rows"))


def vote(neighbours: DataFrame, labels: DataFrame, *, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """q_id, label, votes: the label that most neighbours have; a tie goes to the label that reaches that count first in the order of rank."""
    known = neighbours.join(labels.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")), "vec_id")
    counts = known.groupBy("q_id", "label").agg(F.count("*").alias("votes"), F.max("rank").alias("reached"))
    w = Window.partitionBy("q_id").orderBy(F.desc("votes"), "reached")
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").select("q_id", "label", "votes")


def classify(data: DataFrame, queries: DataFrame, k: int, *, label_col: str = "label", exclude_self: bool = True, summary: Summary | None = None) -> DataFrame:
    """Majority label of the k nearest."""
    found = top(candidates(data, queries, k, exclude_self=exclude_self, summary=summary), k)
    return vote(found, data, label_col=label_col)
