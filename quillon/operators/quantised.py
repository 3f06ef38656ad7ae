"""Scalar quantisation of Fourier coefficients: bits by energy, borders by quantiles or one-dimensional k-means, and bounds from cells."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, series
from . import knn

#: Quantiles a dimension that k-means runs on: what reaches the driver doesn't grow with the rows.
QUANTILES = 512
#: Slices a dimension is sorted in.
SLICES = 64


def coefficients(data: DataFrame, length: int, n: int, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """vec_id, dim, x: a row for each part of each coefficient."""
    return data.select(F.col(id_col).alias("vec_id"), F.posexplode(series.dft(F.col(vector_col), length, n)).alias("dim", "x"))


def energies(coefs: DataFrame) -> DataFrame:
    """dim, energy: the population variance."""
    return coefs.groupBy("dim").agg(F.var_pop("x").alias("energy"))


def allocate(energy: list[float], bits: int) -> list[int]:
    """Bits of each dimension: one at a time to the dimension of most energy (the first of equals), whose energy then falls to a quarter."""
    left, out = list(energy), [0] * len(energy)
    for _ in range(bits * len(energy)):
        d = max(range(len(left)), key=lambda i: (left[i], -i))
        out[d] += 1
        left[d] /= 4
    return out


def equidepth(coefs: DataFrame, bits: list[int]) -> DataFrame:
    """dim, border, x: the inner borders, cells - 1 exact quantiles of each dimension, linear between two ranks.

    Equal values are counted before they are shuffled. Rough quantiles cut each dimension into slices; the sizes of these tell in which slice
    each rank lies and at which place, and only those slices are sorted, so that no task sees more than a slice of a dimension."""
    spark = coefs.sparkSession
    assert max(bits) <= 20
    known = coefs.where(F.col("x").isNotNull())
    rough = known.groupBy("dim").agg(F.percentile_approx("x", [i / SLICES for i in range(1, SLICES)], 10_000).alias("edges")).collect()  # a row a dimension
    edges = spark.createDataFrame(rough, "dim int, edges array<double>")
    counts = known.groupBy("dim", "x").agg(F.count("*").alias("n"))
    values = counts.join(F.broadcast(edges), "dim").select("dim", "x", "n", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("slice"))
    sizes = values.groupBy("dim", "slice").agg(F.sum("n").alias("n")).collect()  # SLICES rows a dimension
    wanted = []
    for d, b in enumerate(bits):
        slices = sorted((r["slice"], r["n"]) for r in sizes if r["dim"] == d)
        starts = np.cumsum([0] + [n for _, n in slices])
        for i in range(1, 2**b) if slices else ():
            at = i / 2**b * (int(starts[-1]) - 1)
            for rank, weight in ((int(at), 1 - at % 1), (int(at) + 1, at % 1)):
                if weight:
                    k = int(np.searchsorted(starts, rank, side="right")) - 1
                    wanted.append((d, slices[k][0], i, rank - int(starts[k]), weight))
    ranks = spark.createDataFrame(wanted, "dim int, slice int, border int, rank long, weight double")
    w = Window.partitionBy("dim", "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    some = values.join(F.broadcast(ranks.select("dim", "slice").distinct()), ["dim", "slice"], "left_semi").withColumn("end", F.sum("n").over(w))
    found = some.join(F.broadcast(ranks), ["dim", "slice"]).where("rank < end AND rank >= end - n")
    return found.groupBy("dim", "border").agg(F.sum(F.col("x") * F.col("weight")).alias("x"))


def equiwidth(coefs: DataFrame, cells: int) -> DataFrame:
    """dim, border, x: the inner borders of cells of equal width between the extremes of each dimension."""
    ends = coefs.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    rows = ends.select("dim", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(cells - 1))).alias("border"))
    return rows.select("dim", "border", (F.col("low") + (F.col("high") - F.col("low")) * F.col("border") / cells).alias("x"))


def lloyd(points: np.ndarray, cells: int, *, rounds: int = 100, least_change: float = 1e-3) -> list[float]:
    """Borders half-way between the sorted centres of one-dimensional k-means from quantile centres; an empty cell keeps its centre."""
    x = np.sort(points)
    centres = np.quantile(x, (np.arange(cells) + 0.5) / cells)
    cost = np.inf
    for _ in range(rounds):
        borders = (centres[1:] + centres[:-1]) / 2
        cell = np.searchsorted(borders, x, side="right")
        n = np.bincount(cell, minlength=cells)
        sums = np.bincount(cell, weights=x, minlength=cells)
        centres = np.sort(np.where(n > 0, sums / np.maximum(n, 1), centres))
        now = float(((x - centres[cell]) ** 2).sum())
        if now >= cost * (1 - least_change):
            break
        cost = now
    return ((centres[1:] + centres[:-1]) / 2).tolist()


def kmeans(coefs: DataFrame, bits: list[int]) -> list[list[float]]:
    """Inner borders of each dimension by k-means on its quantiles."""
    asked = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    rows = coefs.groupBy("dim").agg(F.percentile_approx("x", asked, 100_000).alias("q")).collect()  # a row a dimension
    points = {r["dim"]: np.array(r["q"]) for r in rows}
    return [lloyd(points[d], 2**b) if b and d in points else [] for d, b in enumerate(bits)]


@dataclass
class CellSummary:
    """Cells of Fourier coefficients; a search summary with bounds on both sides."""

    borders: list[list[float]]

    def _coefs(self, x: np.ndarray) -> np.ndarray:
        return arrays.spectrum(x, len(self.borders) // 2)

    def of(self, x: np.ndarray) -> np.ndarray:
        c = self._coefs(x)
        return np.stack([np.searchsorted(b, c[:, d], side="right") for d, b in enumerate(self.borders)], axis=1)

    def _edges(self, q: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = np.stack([np.r_[-np.inf, b][held[:, d]] for d, b in enumerate(self.borders)], axis=1)
        hi = np.stack([np.r_[b, np.inf][held[:, d]] for d, b in enumerate(self.borders)], axis=1)
        return self._coefs(q[None])[0], lo, hi

    def lower(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        c, lo, hi = self._edges(q, held)
        return 2 * (np.maximum(0, np.maximum(lo - c, c - hi)) ** 2).sum(axis=1)

    def upper(self, q: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Of the distance between the coefficients used; infinite in outer cells."""
        c, lo, hi = self._edges(q, held)
        return 2 * (np.maximum(abs(c - lo), abs(c - hi)) ** 2).sum(axis=1)


def fit(data: DataFrame, length: int, *, n: int = 8, bits: int = 4, how: str = "kmeans", **columns_) -> CellSummary:
    """Energies, bits and borders from all rows; what reaches the driver is a few numbers a dimension."""
    coefs = coefficients(data, length, n, **columns_)
    energy = {r["dim"]: r["energy"] for r in energies(coefs).collect()}
    given = allocate([energy.get(d, 0.0) for d in range(2 * n)], bits)
    if how == "kmeans":
        return CellSummary(kmeans(coefs, given))
    rows = equidepth(coefs, given).collect()  # cells a dimension
    return CellSummary([sorted(r["x"] for r in rows if r["dim"] == d) for d in range(2 * n)])


def in_file_order(data: DataFrame, queries: DataFrame, k: int, reads: int, summary: CellSummary) -> DataFrame:
    """Approximate: of the first ``reads`` rows by id that the first bound lets through, the k nearest."""
    first = data.orderBy("vec_id").limit(reads)
    return knn.knn_join(first, queries, k, summary=summary)


def r_delta(histogram: list[tuple[float, float]], delta: float) -> float:
    """The squared distance within which a share 1 - delta of distances falls, linear between the histogram's (distance, cumulative share)
    entries; 0 for delta 1."""
    if delta >= 1 or not histogram:
        return 0.0
    shares = [s for _, s in histogram]
    i = bisect_left(shares, 1 - delta)
    if i == 0:
        return histogram[0][0] ** 2
    if i >= len(histogram):
        return histogram[-1][0] ** 2
    (d0, s0), (d1, s1) = histogram[i - 1], histogram[i]
    return (d0 + (d1 - d0) * (1 - delta - s0) / (s1 - s0)) ** 2


def distance_histogram(data: DataFrame, queries: DataFrame, bins: int = 100) -> list[tuple[float, float]]:
    """(distance, cumulative share) of the nearest distances of the queries, from a 1-nearest search that leaves out the query itself."""
    d = sorted(r["dist"] for r in knn.knn_join(data, queries, 1, exclude_self=True).select("dist").toLocalIterator())
    edges = np.linspace(d[0], d[-1], bins) if d else []
    return [(float(e), bisect_right(d, float(e)) / len(d)) for e in edges]
