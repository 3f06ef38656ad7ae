"""A binary tree over segment statistics, built level by level, and searches that leave out leaves by their bounds.

Building: every upper level is one pass over the data. Tasks route their rows through the tree so far, and send, for each leaf that may be too
large, the extremes of mean and deviation of its segments and half-segments; a shuffle combines them and the driver decides the splits.
What reaches the driver is a few rows a leaf, and there are about rows / leaf_size leaves, whatever a row holds.

Once a leaf's rows are few enough for one task (``LOCAL_NUMBERS``), its subtree is finished there, all such leaves after one shuffle; the
tree is the same. So passes grow with the logarithm of rows / task, not of rows / leaf.

A leaf over ``leaf_size`` splits by the statistic (mean or deviation) of the segment that promises the largest fall of looseness, at the
middle of its range; a half-segment needs more than twice the benefit of the best whole one, and cuts the segment in two from there on.
A leaf that no statistic can part (equal series) stays as it is.

The index is two Parquet tables: nodes, and series sorted by leaf, so that a filter on leaves skips row groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from . import knn


#: Numbers (8 bytes each) of a leaf's rows that one task finishes.
LOCAL_NUMBERS = 4_000_000
#: Pairs of a query and a node that a task holds.
PAIRS = 1 << 18


@dataclass
class Node:
    id: int
    level: int
    ends: list[int]
    parent: int = 0
    split: tuple[int, int, int, float] | None = None  # start, end, 0 mean or 1 deviation, threshold
    size: int = 0
    sketch: np.ndarray | None = None  # segments x (max mean, min mean, max deviation, min deviation)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff([0, *self.ends])


@dataclass
class Tree:
    length: int
    leaf_size: int
    nodes: dict[int, Node] = field(default_factory=dict)
    #: Some series, by hash of the id, that searches choose their filter on.
    sample: np.ndarray | None = None

    def leaves(self) -> list[Node]:
        return [n for _, n in sorted(self.nodes.items()) if n.split is None]

    def visited(self, x: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
        """Every node that rows of x pass, with the rows."""
        todo = [(1, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if len(rows):
                node = self.nodes[at]
                yield node, rows
                if node.split is not None:
                    start, end, which, threshold = node.split
                    part = x[rows, start:end]
                    low = (part.std(axis=1) if which else part.mean(axis=1)) < threshold
                    todo += [(2 * at, rows[low]), (2 * at + 1, rows[~low])]

    def widen(self, synopsis: list) -> None:
        """Takes in what ``synopsis`` of further rows says: (node, segment, max_mean, min_mean, max_sd, min_sd, n)."""
        for at, segment, top, low, wide, narrow, n in synopsis:
            node = self.nodes[at]
            if node.sketch is None:
                node.sketch = np.tile([-np.inf, np.inf, -np.inf, np.inf], (len(node.ends), 1))
            old = node.sketch[segment]
            node.sketch[segment] = (max(old[0], top), min(old[1], low), max(old[2], wide), min(old[3], narrow))
            if segment == 0:
                node.size += n

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(1, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if node.split is None:
                out[rows] = at
            elif len(rows):
                start, end, which, threshold = node.split
                part = x[rows, start:end]
                low = (part.std(axis=1) if which else part.mean(axis=1)) < threshold
                todo += [(2 * at, rows[low]), (2 * at + 1, rows[~low])]
        return out


def halves(ends: list[int]) -> list[tuple[int, int]]:
    """The two halves of each segment of two points or more."""
    cuts = [0, *ends]
    return [h for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= 2 for h in ((a, (a + b) // 2), ((a + b) // 2, b))]


def looseness(n: float, max_mean: float, min_mean: float, max_sd: float) -> float:
    return n * ((max_mean - min_mean) ** 2 + max_sd**2)


def choose(node: Node, stats: dict[tuple[int, int], tuple[float, float, float, float]]) -> tuple[tuple[int, int, int, float], list[int]] | None:
    """The split of an overfull leaf and the segments of its children, or None if nothing parts it. stats: by segment, max mean, min mean,
    max deviation, min deviation."""

    def gains(start: int, end: int) -> list[tuple[float, tuple[int, int, int, float]]]:
        top, low, wide, narrow = stats[start, end]
        n, out = end - start, []
        if top > low:
            out.append((n * (top - low) ** 2 * 0.75, (start, end, 0, (top + low) / 2)))
        if wide > narrow:
            out.append((n * (wide**2 - ((wide + narrow) / 2) ** 2) / 2, (start, end, 1, (wide + narrow) / 2)))
        return out

    cuts = [0, *node.ends]
    whole = [g for a, b in zip(cuts[:-1], cuts[1:], strict=True) for g in gains(a, b)]
    best = max(whole, default=(0.0, None), key=lambda g: g[0])
    half = max((g for h in halves(node.ends) for g in gains(*h)), default=(0.0, None), key=lambda g: g[0])
    if half[1] and half[0] > 2 * best[0]:
        start, end = half[1][:2]
        return half[1], sorted({*node.ends, start, end} - {0})
    return (best[1], node.ends) if best[1] else None


def measured(x: np.ndarray, ends: list[int]) -> dict[tuple[int, int], tuple[float, float, float, float]]:
    """Extremes of mean and deviation of the segments and half-segments of the rows of x."""
    cuts, out = [0, *ends], {}
    for a, b in dict.fromkeys([*zip(cuts[:-1], cuts[1:], strict=True), *halves(ends)]):
        m, s = x[:, a:b].mean(axis=1), x[:, a:b].std(axis=1)
        out[a, b] = (float(m.max()), float(m.min()), float(s.max()), float(s.min()))
    return out


def grown(node: Node, x: np.ndarray, leaf_size: int, most_levels: int) -> list[Node]:
    """The subtree of a leaf whose rows are all here."""
    out, todo = [], [(node, x)]
    while todo:
        n, rows = todo.pop()
        stats, cuts = measured(rows, n.ends), [0, *n.ends]
        n.size, n.split = len(rows), None
        n.sketch = np.array([stats[s] for s in zip(cuts[:-1], cuts[1:], strict=True)])
        out.append(n)
        if n.size > leaf_size and n.level < most_levels and (found := choose(n, stats)):
            n.split, ends = found
            start, end, which, threshold = n.split
            part = rows[:, start:end]
            low = (part.std(axis=1) if which else part.mean(axis=1)) < threshold
            todo += [(Node(2 * n.id, n.level + 1, list(ends), n.id), rows[low]), (Node(2 * n.id + 1, n.level + 1, list(ends), n.id), rows[~low])]
    return out


def _rows(data: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def build(data: DataFrame, leaf_size: int, *, segments: int = 1, id_col: str = "vec_id", vector_col: str = "v", most_levels: int = 60, local_numbers: int = LOCAL_NUMBERS) -> Tree:
    """See above. local_numbers: the most numbers in a leaf that one task finishes."""
    rows = _rows(data, id_col, vector_col)
    first = rows.select(F.size("v").alias("n")).first()
    length = first["n"] if first else 0
    step = max(1, length // segments)
    tree = Tree(length, leaf_size, {1: Node(1, 0, [step * (i + 1) for i in range(segments - 1)] + [length])})
    open_, local = {1}, set()
    for level in range(most_levels + 1):
        if not open_ or not length:
            break
        shared = rows.sparkSession.sparkContext.broadcast((tree, open_))

        def measure(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held, asked = shared.value
            seen: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                batch = batch.dropna()
                if not len(batch):
                    continue
                x = np.stack(batch["v"].to_numpy())
                leaf = held.route(x)
                for at in np.unique(leaf):
                    if at not in asked:
                        continue
                    part = x[leaf == at]
                    for (a, b), (top, low, wide, narrow) in measured(part, held.nodes[at].ends).items():
                        now, old = np.array([top, -low, wide, -narrow, 0]), seen.get((at, a, b))
                        now = now if old is None else np.maximum(now, old)
                        now[4] = len(part) + (0 if old is None else old[4])
                        seen[at, a, b] = now
            yield pd.DataFrame([(*k, v[0], -v[1], v[2], -v[3], int(v[4])) for k, v in seen.items()], columns=["node", "start", "end", "max_mean", "min_mean", "max_sd", "min_sd", "n"])

        found = rows.mapInPandas(measure, "node long, start int, end int, max_mean double, min_mean double, max_sd double, min_sd double, n long")
        merged = found.groupBy("node", "start", "end").agg(F.max("max_mean"), F.min("min_mean"), F.max("max_sd"), F.min("min_sd"), F.sum("n")).collect()
        by: dict[int, dict] = {}
        for node, start, end, *s, n in merged:
            by.setdefault(node, {})[start, end] = tuple(s)
            tree.nodes[node].size = n
        after = set()
        for at in sorted(open_):
            node, stats = tree.nodes[at], by.get(at)
            if stats is None:
                continue
            cuts = [0, *node.ends]
            node.sketch = np.array([stats[s] for s in zip(cuts[:-1], cuts[1:], strict=True)])
            if leaf_size < node.size <= local_numbers // length and level < most_levels:
                local.add(at)
            elif node.size > leaf_size and level < most_levels and (found_split := choose(node, stats)):
                node.split, ends = found_split
                for child in (2 * at, 2 * at + 1):
                    tree.nodes[child] = Node(child, level + 1, list(ends), at)
                    after.add(child)
        open_ = after
    if local:
        shared = rows.sparkSession.sparkContext.broadcast((tree, local))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, wanted = shared.value
            for batch in batches:
                batch = batch.dropna()
                if len(batch):
                    leaf = held.route(np.stack(batch["v"].to_numpy()))
                    mine = np.isin(leaf, list(wanted))
                    yield pd.DataFrame({"leaf_id": leaf[mine], "v": batch["v"].to_numpy()[mine]})

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            held = shared.value[0].nodes[int(group["leaf_id"].iloc[0])]
            nodes = grown(replace(held), np.stack(group["v"].to_numpy()), leaf_size, most_levels)
            return pd.DataFrame({"nodes": [pickle.dumps(nodes)]})

        for r in rows.mapInPandas(place, "leaf_id long, v array<double>").groupBy("leaf_id").applyInPandas(finish, "nodes binary").toLocalIterator():
            tree.nodes |= {n.id: n for n in pickle.loads(r["nodes"])}
    return tree


_SKETCH = "array<struct<max_mean:double,min_mean:double,max_sd:double,min_sd:double>>"
NODES = f"node_id long, parent_id long, level int, is_leaf boolean, size long, ends array<int>, sketch {_SKETCH}, split struct<start:int,end:int,statistic:int,threshold:double>"
SETTINGS, SAMPLE = "length int, leaf_size long", "v array<double>"


def nodes_table(spark: SparkSession, tree: Tree) -> DataFrame:
    rows = [
        (n.id, n.parent, n.level, n.split is None, n.size, n.ends, [] if n.sketch is None else [tuple(map(float, s)) for s in n.sketch], n.split)
        for n in tree.nodes.values()
    ]
    return spark.createDataFrame(rows, NODES)


def loaded(nodes: DataFrame, leaf_size: int) -> Tree:
    """A tree from its table."""
    tree = Tree(0, leaf_size)
    for r in nodes.toLocalIterator():
        tree.nodes[r["node_id"]] = Node(r["node_id"], r["level"], list(r["ends"]), r["parent_id"], tuple(r["split"]) if r["split"] else None, r["size"], np.array([list(s) for s in r["sketch"]]) if r["sketch"] else None)
    tree.length = tree.nodes[1].ends[-1] if 1 in tree.nodes else 0
    return tree


def assigned(data: DataFrame, tree: Tree, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """leaf_id, vec_id, v."""
    shared = data.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.dropna()
            if len(batch):
                yield pd.DataFrame({"leaf_id": shared.value.route(np.stack(batch["v"].to_numpy())), "vec_id": batch["id"], "v": batch["v"]})

    return _rows(data, id_col, vector_col).mapInPandas(run, "leaf_id long, vec_id long, v array<double>")


SYNOPSIS = "node_id long, segment int, max_mean double, min_mean double, max_sd double, min_sd double, n long"


def synopsis(data: DataFrame, tree: Tree, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """The extremes of the segments of every node that rows of data pass: a row a node and segment, combined before the shuffle."""
    shared = data.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            batch = batch.dropna()
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            for node, rows in shared.value.visited(x):
                m, sd = arrays.segment_stats(x[rows], node.ends)
                for k in range(len(node.ends)):
                    now = np.array([m[:, k].max(), -m[:, k].min(), sd[:, k].max(), -sd[:, k].min(), 0.0])
                    old = seen.get((node.id, k))
                    now = now if old is None else np.maximum(now, old)
                    now[4] = len(rows) + (0 if old is None else old[4])
                    seen[node.id, k] = now
        yield pd.DataFrame([(*k, v[0], -v[1], v[2], -v[3], int(v[4])) for k, v in seen.items()], columns=[c.split()[0] for c in SYNOPSIS.split(", ")])

    found = _rows(data, id_col, vector_col).mapInPandas(run, SYNOPSIS)
    return _combined(found)


def _combined(rows: DataFrame) -> DataFrame:
    merged = rows.groupBy("node_id", "segment").agg(F.max("max_mean").alias("max_mean"), F.min("min_mean").alias("min_mean"), F.max("max_sd").alias("max_sd"), F.min("min_sd").alias("min_sd"), F.sum("n").alias("n"))
    return merged.select(*[c.split()[0] for c in SYNOPSIS.split(", ")])


def sampled(series: DataFrame, tree: Tree) -> np.ndarray:
    """About SEED_ROWS series chosen by hash: rows that lie together are of one leaf."""
    rows = max(1, sum(n.size for n in tree.leaves()))
    some = F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(1 << 30)) < min(1 << 30, (knn.SEED_ROWS << 30) // rows + 1)
    got = series.where(some).limit(2 * knn.SEED_ROWS).select("v").toPandas()["v"]
    return np.stack(got.to_numpy()) if len(got) else np.zeros((0, tree.length))


def _at_once(*jobs: Callable[[], object]) -> list:
    """The results of small jobs that don't need each other."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def write(data: DataFrame, tree: Tree, path: str, **columns_) -> None:
    """nodes, settings and series under path; series sorted by leaf. What is appended later has numbers of its own (``streaming.ingest``)."""
    spark = data.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def to(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    def series() -> None:
        to(assigned(data, tree, **columns_).repartitionByRange(parts, "leaf_id", "vec_id").sortWithinPartitions("leaf_id", "vec_id"), "series/batch=-1")
        held = spark.read.schema("leaf_id long, vec_id long, v array<double>").parquet(f"{path}/series/batch=-1")
        to(spark.createDataFrame([(x.tolist(),) for x in sampled(held, tree)], SAMPLE).coalesce(1), "sample")

    _at_once(
        series,
        lambda: to(nodes_table(spark, tree), "nodes"),
        lambda: to(spark.createDataFrame([(tree.length, tree.leaf_size)], SETTINGS), "settings"),
        lambda: to(spark.createDataFrame([], SYNOPSIS), "synopsis/batch=-1"),
    )


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Tree]:
    """Series and tree, with everything appended so far: the synopsis is read after the series are listed, so it covers them."""
    series = spark.read.schema("leaf_id long, vec_id long, v array<double>, batch long").parquet(f"{path}/series").drop("batch")

    def of(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    settings, tree, kept, widened = _at_once(
        lambda: of("settings", SETTINGS).first(),
        lambda: loaded(of("nodes", NODES), 0),
        lambda: of("sample", SAMPLE).toPandas()["v"],
        lambda: list(_combined(of("synopsis", SYNOPSIS + ", batch long").drop("batch")).toLocalIterator()),
    )
    tree.leaf_size = settings["leaf_size"]
    tree.sample = np.stack(kept.to_numpy()) if len(kept) else np.zeros((0, tree.length))
    tree.widen(widened)
    return series, tree


def bounds(tree: Tree | None, qs: np.ndarray, which: str = "lower", nodes: list[Node] | None = None) -> np.ndarray:
    """Squared lower or upper bounds, queries x nodes (the leaves, if not told)."""
    nodes = tree.leaves() if nodes is None else nodes
    out = np.full((len(qs), len(nodes)), np.inf)
    by: dict[tuple[int, ...], list[int]] = {}
    for i, n in enumerate(nodes):
        if n.sketch is not None:
            by.setdefault(tuple(n.ends), []).append(i)
    for ends, at in by.items():
        m, s = arrays.segment_stats(qs, list(ends))
        lengths = np.diff([0, *ends])
        for i in at:
            k = nodes[i].sketch
            if which == "lower":
                gap = np.maximum(0, np.maximum(k[:, 1] - m, m - k[:, 0])) ** 2 + np.maximum(0, np.maximum(k[:, 3] - s, s - k[:, 2])) ** 2
            else:
                gap = np.maximum(abs(m - k[:, 1]), abs(m - k[:, 0])) ** 2 + (s + k[:, 2]) ** 2
            out[:, i] = (gap * lengths).sum(axis=1)
    return out


def leaf_scan(series: DataFrame, block: knn.Queries, tree, allowed: np.ndarray, k: int, *, limits: np.ndarray | None = None, summary: knn.Summary | None = None) -> DataFrame:
    """q_id, vec_id, d2 of the k best of each task among the leaves allowed (queries x leaves); only those leaves are read. tree:
    whatever has leaves() with ids."""
    leaves = np.array([n.id for n in tree.leaves()])
    wanted = leaves[allowed.any(axis=0)]
    rows = series.where(F.col("leaf_id").isin(wanted.tolist())) if len(wanted) < min(len(leaves), 2000) else series
    shared = series.sparkSession.sparkContext.broadcast((block, leaves, allowed, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, qs), names, may, bound = shared.value
        best = [knn.Best(k, np.inf if bound is None else float(bound[i]) * (1 + 1e-12) + 1e-12) for i in range(len(q_ids))]
        for batch in batches:
            x, ids, leaf = arrays.matrix(batch, "v", "vec_id", "leaf_id")
            if not len(ids):
                continue
            at = np.searchsorted(names, leaf)
            asked = np.flatnonzero(may[:, np.unique(at)].any(axis=1))  # a batch is of few leaves
            if not len(asked):
                continue
            live = may[np.ix_(asked, at)]
            if summary:
                held, some = summary.of(x), np.array([best[i].bound for i in asked])
                live &= knn.lowers(summary, qs[asked], held) <= some[:, None] + 1e-9
            knn.offer_near([best[i] for i in asked], x, ids, qs[asked], live)
        for i, b in enumerate(best):
            if len(b.ids):
                yield pa.RecordBatch.from_pydict({"q_id": np.full(len(b.ids), q_ids[i]), "vec_id": b.ids, "d2": b.d})

    return rows.select("leaf_id", "vec_id", "v").mapInArrow(run, "q_id long, vec_id long, d2 double")


def kth_distances(found: DataFrame, k: int, q_ids: np.ndarray) -> np.ndarray:
    """The k-th squared distance of each query; infinity where there are fewer."""
    w = Window.partitionBy("q_id").orderBy("d2", "vec_id")
    rows = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("q_id", "d2").collect()  # a row a query of the block
    held = {r["q_id"]: r["d2"] for r in rows}
    return np.array([held.get(int(q), np.inf) for q in q_ids])


def sample_kth(tree: Tree, qs: np.ndarray, k: int) -> np.ndarray:
    """The k-th squared distance of each query to the sample of the index: the k-th over all series is no larger."""
    return np.array([np.partition(arrays.squared_distances(tree.sample, q), k - 1)[k - 1] for q in qs])


def nearest_leaves(lower: np.ndarray, n: int) -> np.ndarray:
    """queries x leaves: the n of least lower bound."""
    out = np.zeros(lower.shape, bool)
    np.put_along_axis(out, np.argsort(lower, axis=1, kind="stable")[:, :n], True, axis=1)
    return out & np.isfinite(lower)


def search(series: DataFrame, tree: Tree, queries: DataFrame, k: int, *, approximate_leaves: int = 80, probes: int = 0, epsilon: float = 0.0, r_delta: float = 0.0, eapca_threshold: float = 0.25, sax_threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """q_id, vec_id, rank, dist.

    The leaves of least bound give each query a first k-th distance. With ``probes`` these leaves are the answer; else all leaves whose bound
    is at most that over (1 + epsilon), on squared distances, are searched. Where these first leaves of an exact search are together most of
    the index, as with many queries, reading them first would be a pass more: the sample that the index keeps gives the distance then. If less than ``eapca_threshold`` of the leaves goes, rows are
    compared one by one; else rows pass a filter by symbols first, unless a sample shows that less than ``sax_threshold`` of them would go.
    r_delta: a squared distance that is near enough: queries whose first answer is within (1 + epsilon) of it stop there."""
    parts = []
    for block in knn.query_blocks(queries, id_col, vector_col):
        lower = bounds(tree, block[1])
        first = nearest_leaves(lower, probes or approximate_leaves)
        kept = 0 if tree.sample is None else len(tree.sample)
        if not (probes or epsilon or r_delta) and kept >= k and first.any(axis=0).mean() > 0.5:
            kth = sample_kth(tree, block[1], k)
        else:
            approximate = leaf_scan(series, block, tree, first, k)
            if probes:
                parts.append(approximate)
                continue
            kth = kth_distances(approximate, k, block[0])
        allowed = lower <= (kth / (1 + epsilon) + 1e-9)[:, None]
        if r_delta:
            stop = kth <= r_delta * (1 + epsilon)
            allowed[stop] = first[stop]
        if epsilon or r_delta:
            allowed |= first  # what is known already stays in the answer
        summary = None
        if 1 - allowed.mean() >= eapca_threshold and tree.length >= 16:
            summary = knn.SaxSummary()
            sample = sampled(series, tree) if tree.sample is None else tree.sample
            if len(sample):
                held = summary.of(sample)
                gone = np.mean([(summary.lower(q, held) > d).mean() for q, d in zip(block[1], kth, strict=True)])
                summary = summary if gone >= sax_threshold else None
        parts.append(leaf_scan(series, block, tree, allowed, k, limits=kth, summary=summary))
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    return knn.top(found if found is not None else series.sparkSession.createDataFrame([], "q_id long, vec_id long, d2 double"), k)


def found_stepwise(series: DataFrame, tree: Tree, queries: DataFrame, k: int, wave: int = 8) -> DataFrame:
    """q_id, vec_id, rank, dist, leaves: exact neighbours, each given as soon as it is proven. Leaves are taken by rising bound, ``wave`` of
    them a pass; the i-th nearest is proven once its distance is within the bound of all leaves not read, and ``leaves`` tells how many had
    been read then. Queries whose k-th is proven read no further."""
    spark = series.sparkSession
    rows: list[tuple] = []
    for ids, qs in knn.query_blocks(queries, "vec_id", "v"):
        lower = bounds(tree, qs)
        order = np.argsort(lower, axis=1, kind="stable")
        best = {int(q): knn.Best(k) for q in ids}
        given = np.zeros(len(ids), int)
        for at in range(0, lower.shape[1], wave):
            open_ = np.flatnonzero(given < k)
            if not len(open_):
                break
            now = np.zeros((len(open_), lower.shape[1]), bool)
            np.put_along_axis(now, order[open_, at : at + wave], True, axis=1)
            for r in leaf_scan(series, (ids[open_], qs[open_]), tree, now, k, limits=np.array([best[int(ids[i])].bound for i in open_])).collect():  # k rows a query and task
                best[r["q_id"]].offer(np.array([r["d2"]]), np.array([r["vec_id"]]))
            end = min(at + wave, lower.shape[1])
            for i in open_:
                b = best[int(ids[i])]
                next_ = lower[i, order[i, end]] if end < lower.shape[1] else np.inf
                while given[i] < len(b.d) and b.d[given[i]] < next_ - 1e-9:
                    rows.append((int(ids[i]), int(b.ids[given[i]]), int(given[i]) + 1, round(float(b.d[given[i]]) ** 0.5, 6), end))
                    given[i] += 1
    return spark.createDataFrame(rows, "q_id long, vec_id long, rank int, dist double, leaves int")


def query_stats(series: DataFrame, tree: Tree, queries: DataFrame, k: int, *, approximate_leaves: int = 80) -> DataFrame:
    """q_id, leaves, leaves_read, rows, rows_read, approximate, exact of an exact search: how much of the index it reads, and the k-th
    distance of the first answer and of the last."""
    out = []
    size = np.array([n.size for n in tree.leaves()])
    for block in knn.query_blocks(queries, "vec_id", "v"):
        lower = bounds(tree, block[1])
        first = nearest_leaves(lower, approximate_leaves)
        kth = kth_distances(leaf_scan(series, block, tree, first, k), k, block[0])
        read_ = (lower <= (kth + 1e-9)[:, None]) | first
        last = kth_distances(leaf_scan(series, block, tree, read_, k, limits=kth), k, block[0])
        for i, q in enumerate(block[0]):
            out.append((int(q), len(size), int(read_[i].sum()), int(size.sum()), int(size[read_[i]].sum()), round(float(kth[i]) ** 0.5, 6), round(float(last[i]) ** 0.5, 6)))
    return series.sparkSession.createDataFrame(out, "q_id long, leaves int, leaves_read int, rows long, rows_read long, approximate double, exact double")


def mindists(spark: SparkSession, tree: Tree, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """q_id, node_id, level, is_leaf, segments, lower, upper, root_qos of every node for every query. Tasks make the pairs, each of some nodes
    with a block of queries, a bounded number at a time."""
    nodes = [n for _, n in sorted(tree.nodes.items()) if n.sketch is not None]
    held, out = spark.sparkContext.broadcast(nodes), None
    schema = "q_id long, node_id long, level int, is_leaf boolean, segments int, lower double, upper double, root_qos double"
    for block in knn.query_blocks(queries, id_col, vector_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qs = shared.value
            step = max(1, PAIRS // len(ids))
            for batch in batches:
                for at in range(0, len(batch), step):
                    some = [held.value[i] for i in batch["id"].iloc[at : at + step]]
                    low, up = bounds(None, qs, "lower", some), bounds(None, qs, "upper", some)
                    for i, n in enumerate(some):
                        qos = float(sum(looseness(a, *s[:3]) for a, s in zip(n.lengths, n.sketch, strict=True))) ** 0.5
                        yield pd.DataFrame({"q_id": ids, "node_id": n.id, "level": n.level, "is_leaf": n.split is None, "segments": len(n.ends), "lower": low[:, i], "upper": up[:, i], "root_qos": qos})

        part = spark.range(len(nodes)).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def extremes(series: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """q_id, node_id, n, low, high: for each query and node the number of rows under it and the extremes of their squared distances, by
    differences. Tasks climb from the leaves they read to the nodes above; the id of a parent is half of its children's."""
    out, schema = None, "q_id long, node_id long, n long, low double, high double"
    for block in knn.query_blocks(queries, id_col, vector_col):
        shared = series.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, qs = shared.value
            for batch in batches:
                x, leaf = arrays.matrix(batch, "v", "leaf_id")
                if not len(leaf):
                    continue
                order = np.argsort(leaf, kind="stable")
                x = x[order]
                leaves, starts, sizes = np.unique(leaf[order], return_index=True, return_counts=True)
                names = np.array(sorted({int(a) >> up for a in leaves for up in range(int(a).bit_length())}, reverse=True))  # children come first
                place = {a: i for i, a in enumerate(names.tolist())}
                mine, parent = [place[a] for a in leaves.tolist()], [place.get(a >> 1) for a in names.tolist()]
                for at in range(0, len(ids), knn.TILE):
                    d = np.stack([arrays.squared_distances(x, q) for q in qs[at : at + knn.TILE]], axis=1)
                    n, low, high = np.zeros(len(names), np.int64), np.full((len(names), d.shape[1]), np.inf), np.full((len(names), d.shape[1]), -np.inf)
                    n[mine], low[mine], high[mine] = sizes, np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
                    for i, up in enumerate(parent):
                        if up is not None:
                            n[up] += n[i]
                            np.minimum(low[up], low[i], out=low[up])
                            np.maximum(high[up], high[i], out=high[up])
                    yield pa.RecordBatch.from_pydict({"q_id": np.tile(ids[at : at + knn.TILE], len(names)), "node_id": np.repeat(names, d.shape[1]), "n": np.repeat(n, d.shape[1]), "low": low.ravel(), "high": high.ravel()})

        part = series.select("leaf_id", "v").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else series.sparkSession.createDataFrame([], schema)
    return out.groupBy("q_id", "node_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def pruned_nodes(series: DataFrame, tree: Tree, queries: DataFrame, k: int, approximate_leaves: int = 80) -> DataFrame:
    """The nodes whose bound passes the first k-th distance (bsf) of a query, without those below them. Tasks make the pairs, of some nodes in
    preorder, so that a node's ancestors are among them or above the first, and send only the nodes that are cut."""
    spark = series.sparkSession
    nodes = sorted((n for n in tree.nodes.values() if n.sketch is not None), key=lambda n: bin(n.id))
    held, out, schema = spark.sparkContext.broadcast(nodes), None, "q_id long, node_id long, level int, bsf double, lower double"
    for block in knn.query_blocks(queries, "vec_id", "v"):
        kth = kth_distances(leaf_scan(series, block, tree, nearest_leaves(bounds(tree, block[1]), approximate_leaves), k), k, block[0])
        shared = spark.sparkContext.broadcast((block, kth))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            (ids, qs), bsf = shared.value
            step, by = max(1, PAIRS // len(ids)), {n.id: n for n in held.value}
            for batch in batches:
                for at in range(0, len(batch), step):
                    some = [held.value[i] for i in batch["id"].iloc[at : at + step]]
                    above = [by[some[0].id >> up] for up in range(some[0].id.bit_length() - 1, 0, -1)]
                    low = bounds(None, qs, "lower", above + some)
                    gone = {0: np.zeros(len(ids), bool)}  # by node, the queries for which it or a node above it is cut
                    for i, n in enumerate(above + some):
                        over = gone[n.id >> 1]
                        cut = (low[:, i] > bsf) & ~over
                        gone[n.id] = over | cut
                        if i >= len(above) and cut.any():
                            yield pd.DataFrame({"q_id": ids[cut], "node_id": n.id, "level": n.level, "bsf": bsf[cut], "lower": low[cut, i]})

        part = spark.range(len(nodes)).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.select("q_id", "node_id", "level", F.round(F.sqrt("bsf"), 6).alias("bsf"), F.round(F.sqrt("lower"), 6).alias("lower"))


def progressive(series: DataFrame, tree: Tree, queries: DataFrame) -> DataFrame:
    """q_id, step, leaf_id, lower, bsf, proven: leaves by rising bound, the least distance so far, and whether no leaf after can hold a nearer
    row. Distances come from one pass, the least of each leaf only."""
    spark = series.sparkSession
    parts = []
    for block in knn.query_blocks(queries, "vec_id", "v"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qs = shared.value
            for batch in batches:
                if len(batch):
                    x, leaf = np.stack(batch["v"].to_numpy()), batch["leaf_id"].to_numpy()
                    names, at = np.unique(leaf, return_inverse=True)
                    for i, q in enumerate(qs):
                        best = np.full(len(names), np.inf)
                        np.minimum.at(best, at, arrays.squared_distances(x, q))
                        yield pd.DataFrame({"q_id": ids[i], "leaf_id": names, "d2": best})

        parts.append(series.select("leaf_id", "v").mapInPandas(run, "q_id long, leaf_id long, d2 double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("q_id", "leaf_id").agg(F.min("d2").alias("d2"))
    lower = mindists(spark, tree, queries).where("is_leaf").select("q_id", F.col("node_id").alias("leaf_id"), "lower")
    w = Window.partitionBy("q_id").orderBy("lower", "leaf_id")
    steps = best.join(lower, ["q_id", "leaf_id"]).withColumn("step", F.row_number().over(w)).withColumn("bsf", F.min("d2").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("lower").over(w))
    return steps.select("q_id", "step", "leaf_id", F.round(F.sqrt("lower"), 6).alias("lower"), F.round(F.sqrt("bsf"), 6).alias("bsf"), F.coalesce(F.col("next") > F.col("bsf"), F.lit(True)).alias("proven"))


def leaf_stats(nodes: DataFrame, leaf_size: int) -> DataFrame:
    """One row: numbers of nodes and leaves, fill and height of leaves."""
    leaf = lambda x: F.when(F.col("is_leaf"), x)
    fill = F.col("size") / leaf_size
    return nodes.agg(
        F.count("*").alias("n_nodes"), F.count(leaf(F.lit(1))).alias("n_leaves"), F.sum(leaf(F.col("size"))).alias("n_series"),
        F.min(leaf(fill)).alias("min_fill"), F.max(leaf(fill)).alias("max_fill"), F.avg(leaf(fill)).alias("avg_fill"), F.stddev_pop(leaf(fill)).alias("sd_fill"),
        F.min(leaf(F.col("level"))).alias("min_height"), F.max(leaf(F.col("level"))).alias("max_height"), F.avg(leaf(F.col("level"))).alias("avg_height"),
    )
