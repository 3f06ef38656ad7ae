"""Symbolic words as an index: a prefix tree over symbols, one level a pass, and searches by word.

A node holds, for each segment, how many leading bits of the symbol are fixed and their values. An overfull node fixes one more bit of
the segment whose next breakpoint lies within three deviations of the node's mean there and nearest to it; without such a segment, of the
one with fewest fixed bits. Leaves are looked up by the bits of a word, which is an equi-join on leaf ids; nothing is broadcast but the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import knn


@dataclass
class Prefix:
    id: int
    bits: tuple[int, ...]
    values: tuple[int, ...]
    cut: int | None = None  # the segment that gets one more bit
    size: int = 0


@dataclass
class WordTree:
    segments: int = 16
    most_bits: int = 8
    nodes: dict[int, Prefix] = field(default_factory=dict)

    def words(self, x: np.ndarray) -> np.ndarray:
        return arrays.symbols(arrays.paa(x, self.segments), 1 << self.most_bits)

    def route(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        todo = [(1, np.arange(len(words)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if node.cut is None:
                out[rows] = at
            elif len(rows):
                bit = (words[rows, node.cut] >> (self.most_bits - node.bits[node.cut] - 1)) & 1
                todo += [(2 * at, rows[bit == 0]), (2 * at + 1, rows[bit == 1])]
        return out

    def leaves(self) -> list[Prefix]:
        return [n for _, n in sorted(self.nodes.items()) if n.cut is None]

    def breakpoint(self, node: Prefix, segment: int) -> float:
        """The breakpoint that the next bit of a segment decides by."""
        bits = node.bits[segment] + 1
        return arrays.breakpoints(1 << bits)[2 * node.values[segment]]

    def choose(self, node: Prefix, means: np.ndarray, sds: np.ndarray) -> int | None:
        free = [s for s in range(self.segments) if node.bits[s] < self.most_bits]
        gap = {s: abs(self.breakpoint(node, s) - means[s]) for s in free}
        inside = [s for s in free if gap[s] <= 3 * sds[s]]
        if inside:
            return min(inside, key=lambda s: (gap[s], s))
        return min(free, key=lambda s: (node.bits[s], s), default=None)

    def lower(self, q: np.ndarray) -> dict[int, float]:
        """Squared lower bounds from a series to each leaf, at the leaf's own cardinalities."""
        means, out = arrays.paa(q[None], self.segments)[0], {}
        for node in self.nodes.values():
            if node.cut is None:
                total = 0.0
                for m, b, v in zip(means, node.bits, node.values, strict=True):
                    if b:
                        cuts = [-np.inf, *arrays.breakpoints(1 << b), np.inf]
                        total += max(0.0, cuts[v] - m, m - cuts[v + 1]) ** 2
                out[node.id] = total * (len(q) // self.segments)
        return out


def build(data: DataFrame, leaf_size: int, *, segments: int = 16, most_bits: int = 8, vector_col: str = "v", most_levels: int = 62) -> WordTree:
    """Counts, means and deviations of overfull nodes in one pass a level; what reaches the driver is a row a node."""
    tree = WordTree(segments, most_bits, {1: Prefix(1, (0,) * segments, (0,) * segments)})
    rows = data.select(F.col(vector_col).cast("array<double>").alias("v"))
    open_ = {1}
    for level in range(most_levels):
        if not open_:
            break
        shared = rows.sparkSession.sparkContext.broadcast((tree, open_))

        def measure(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held, asked = shared.value
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                batch = batch.dropna()
                if len(batch):
                    x = np.stack(batch["v"].to_numpy())
                    means = arrays.paa(x, held.segments)
                    leaf = held.route(held.words(x))
                    for at in asked.intersection(leaf.tolist()):
                        m = means[leaf == at]
                        seen[at] = seen.get(at, 0) + np.r_[len(m), m.sum(axis=0), (m * m).sum(axis=0)]
            yield pd.DataFrame([(k, i, x) for k, v in seen.items() for i, x in enumerate(v)], columns=["node", "i", "x"])

        found = rows.mapInPandas(measure, "node long, i int, x double").groupBy("node", "i").agg(F.sum("x").alias("x")).collect()
        by: dict[int, np.ndarray] = {}
        for r in found:
            by.setdefault(r["node"], np.zeros(1 + 2 * segments))[r["i"]] = r["x"]
        after = set()
        for at in sorted(open_):
            if at not in by:
                continue
            node, (n, *sums) = tree.nodes[at], by[at]
            node.size = int(n)
            means = np.array(sums[:segments]) / n
            sds = np.sqrt(np.maximum(0, np.array(sums[segments:]) / n - means**2))
            if n > leaf_size and level + 1 < most_levels and (cut := tree.choose(node, means, sds)) is not None:
                node.cut = cut
                for bit in (0, 1):
                    bits, values = list(node.bits), list(node.values)
                    bits[cut], values[cut] = bits[cut] + 1, 2 * values[cut] + bit
                    tree.nodes[2 * at + bit] = Prefix(2 * at + bit, tuple(bits), tuple(values))
                    after.add(2 * at + bit)
        open_ = after
    return tree


def assigned(data: DataFrame, tree: WordTree, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """leaf_id, vec_id, v, word."""
    shared = data.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.dropna()
            if len(batch):
                word = shared.value.words(np.stack(batch["v"].to_numpy()))
                yield pd.DataFrame({"leaf_id": shared.value.route(word), "vec_id": batch["id"], "v": batch["v"], "word": list(word.astype(np.int32))})

    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, "leaf_id long, vec_id long, v array<double>, word array<int>")


def home_leaf_join(data: DataFrame, queries: DataFrame, tree: WordTree, k: int) -> DataFrame:
    """Approximate: the k nearest among the rows of the query's own leaf, by an equi-join on the leaf; a leaf holds leaf_size rows or so."""
    left = assigned(data, tree).select("leaf_id", "vec_id", "v")
    right = assigned(queries, tree).select("leaf_id", F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    from ..functions.series import squared_distance

    return knn.top(left.join(right, "leaf_id").select("q_id", "vec_id", squared_distance(F.col("v"), F.col("q")).alias("d2")), k)


def search(rows: DataFrame, tree: WordTree, queries: DataFrame, k: int, *, first_leaves: int = 8) -> DataFrame:
    """Exact, over rows with leaf_id: the leaves of least bound give a first k-th distance, all leaves within it are scanned, rows behind
    the bound of their word."""
    from . import tree as trees

    parts = None
    for block in knn.query_blocks(queries, "vec_id", "v"):
        lower = np.array([[low[n.id] for n in tree.leaves()] for low in map(tree.lower, block[1])])
        kth = trees.kth_distances(trees.leaf_scan(rows, block, tree, trees.nearest_leaves(lower, first_leaves), k), k, block[0])
        found = trees.leaf_scan(rows, block, tree, lower <= (kth + 1e-9)[:, None], k, limits=kth, summary=knn.SaxSummary(tree.segments, 1 << tree.most_bits))
        parts = found if parts is None else parts.unionByName(found)
    return knn.top(parts if parts is not None else rows.sparkSession.createDataFrame([], "q_id long, vec_id long, d2 double"), k)


def envelopes(rows: DataFrame) -> DataFrame:
    """leaf_id, pos, upper, lower: the pointwise extremes of the series of each leaf."""
    return rows.select("leaf_id", F.posexplode("v").alias("pos", "x")).groupBy("leaf_id", "pos").agg(F.max("x").alias("upper"), F.min("x").alias("lower"))
