"""Nearest series under dynamic time warping within a band, behind a cascade of lower bounds.

Warping costs are at most the Euclidean ones, so the k-th Euclidean distance, found first, bounds the k-th cost of each query. What the symbols'
and the envelope's bounds leave is compared by rising bound, a few rows of many queries at a time; each round brings the bounds down. Pairs
meet the bound by the row's envelope before they are compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import arrays
from . import knn, tree

#: Rows that a query is compared with in the first round; each after has four times as many.
ROUND = 32
#: Pairs that are compared at once, few enough for a cache.
PAIRS = 4096


def offering(band: int):
    """As ``knn.offer_near``, by warping costs."""

    def offer(best: list[knn.Best], x: np.ndarray, ids: np.ndarray, qs: np.ndarray, live: np.ndarray | None = None) -> None:
        (upper, lower), (above, below) = arrays.envelope(qs, band), arrays.envelope(x, band)
        waiting = []  # by query: rows by rising bound, and their bounds
        for i, b in enumerate(best):
            rows = np.arange(len(ids)) if live is None else np.flatnonzero(live[i])
            low = arrays.lb_keogh(x[rows] if len(rows) < len(ids) else x, upper[i], lower[i])
            near = np.flatnonzero(low <= b.bound + 1e-9)
            near = near[np.argsort(low[near], kind="stable")]
            waiting.append((rows[near], low[near]))
        take = ROUND
        while True:
            taken = []
            for i, (rows, low) in enumerate(waiting):
                n = np.searchsorted(low, best[i].bound + 1e-9, side="right")
                taken.append(rows[: min(n, take)])
                waiting[i] = rows[take:n], low[take:n]
            which, rows = np.repeat(np.arange(len(best)), [len(t) for t in taken]), np.concatenate(taken)
            if not len(rows):
                return
            bounds, d = np.array([b.bound for b in best]) + 1e-9, np.full(len(rows), np.inf)
            for at in range(0, len(rows), PAIRS):
                w, r = which[at : at + PAIRS], rows[at : at + PAIRS]
                near = np.flatnonzero(arrays.lb_keogh(qs[w], above[r], below[r]) <= bounds[w])
                w, r = w[near], r[near]
                d[at + near] = arrays.dtw(x[r], qs[w], band, bounds[w], (upper[w], lower[w]))
            ends = np.cumsum([len(t) for t in taken])
            for b, mine, end in zip(best, taken, ends, strict=True):
                near = np.isfinite(d[end - len(mine) : end])
                b.offer(d[end - len(mine) : end][near], ids[mine[near]])
            take *= 4

    return offer


class WarpedSaxSummary(knn.SaxSummary):
    """Symbols against the segment means of the query's envelope: bounds warping costs from below."""

    def __init__(self, band: int, segments: int = 16, cardinality: int = 256):
        super().__init__(segments, cardinality)
        self.band = band

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(super().of(x).T, np.intp)  # a segment's symbols lie together

    def lower(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        upper, lower = arrays.envelope(q, self.band)
        top, low = (arrays.paa(e[None], self.segments)[0] for e in (upper, lower))
        gaps = np.maximum(0, np.maximum(self.low - top[:, None], low[:, None] - self.high)) ** 2
        return (len(q) // self.segments) * sum(g.take(s) for g, s in zip(gaps, held, strict=True))


def candidates(data: DataFrame, queries: DataFrame, k: int, band: int, *, summary: bool = False, exclude_self: bool = False) -> DataFrame:
    """The tasks' rows of all query blocks, as ``knn.candidates``."""
    parts, columns = [], {"id_col": "vec_id", "vector_col": "v", "exclude_self": exclude_self}
    for block in knn.query_blocks(queries, "vec_id", "v"):
        bounds = tree.kth_distances(knn.scan(data, block, k, **columns).where("vec_id IS NOT NULL"), k, block[0])
        parts.append(knn.scan(data, block, k, summary=WarpedSaxSummary(band) if summary else None, bounds=bounds, offer=offering(band), **columns))
    return knn._union(parts, data)


def dtw_join(data: DataFrame, queries: DataFrame, k: int, band: int, *, summary: bool = False, exclude_self: bool = False) -> DataFrame:
    """q_id, vec_id, rank, dist (root of the squared cost)."""
    return knn.top(candidates(data, queries, k, band, summary=summary, exclude_self=exclude_self), k)


def dtw_classify(data: DataFrame, queries: DataFrame, k: int, band: int, *, summary: bool = False) -> DataFrame:
    return knn.vote(knn.top(candidates(data, queries, k, band, summary=summary, exclude_self=True), k), data)
