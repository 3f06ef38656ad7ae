"""Approximate nearest neighbours by cosine: inverted lists, and an adaptive scan of dimensions within each probed list.

Fitting takes a bounded sample (``sample`` vectors, chosen by the hash of the id): unit length, a random rotation, and spherical k-means for
the lists. The number of lists to probe is the least that reaches ``aim`` recall against brute force within the sample; queries further from
their nearest centre, whose neighbours are more scattered, have numbers of their own, never a lesser one. Each query goes on to further
lists until those it probes hold ``spare`` times the rows it needs. Every row is indexed. Lists grow with the root of the rows until the
sample can't define more; from there on the lists themselves grow, and are cut into more blocks.

Lists are cut into blocks of bounded size by hash, so a list that a third of all vectors fall in is many tasks; queries go to every block
of each list they probe, in portions, and carry a bound: their k-th least distance to ``seeds`` of the sampled rows. A block holds its
rotated vectors as column blocks of ``step`` dimensions and is read ``rows`` vectors at a time. After each column block the hypothesis that
a candidate is as near as the query's best so far is tested on its partial distance: it is rejected, and the candidate abandoned, where the
partial distance passes a share of the bound that true neighbours of the sample pass with a chance of ``alpha`` only. The next column block
is a matrix product over the queries and candidates that are left, or goes pair by pair once few are. What survives all blocks gets its
exact cosine from the original vectors in double precision; each block gives its k best and a window keeps the k best of all. Queries with
fewer than k rows then (where many rows share the query's id) are asked again of all lists, without a bound.

Defined results: vectors that are null, empty, zero, of another length than most rows of the table, or that hold null or non-finite
components take no part; rows with a null id neither; ties go to the smaller id; fewer than k candidates give fewer rows; other columns are
ignored. A query's own row is left out by its id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, columns, written


@dataclass(frozen=True)
class Settings:
    #: The bound of the sample that rotation, lists and probes are fitted on.
    sample: int = 16_384
    #: Rows of the sample that give a query its first bound.
    seeds: int = 4096
    aim: float = 0.95
    spare: int = 4
    step: int = 16
    #: The chance that a test abandons a true neighbour; all tests of a candidate share it.
    alpha: float = 0.01
    rows: int = 256
    block: int = 8192
    portion: int = 4096
    seed: int = 5


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    #: Probes by similarity to the nearest centre: below edges[i] and not below edges[i - 1], depths[i].
    edges: np.ndarray
    depths: np.ndarray
    #: After each column block but the last, the share of the bound that a neighbour's partial distance may have.
    shares: np.ndarray
    #: Rotated unit vectors, and ids, of the rows that give first bounds.
    seeds: np.ndarray
    seed_ids: np.ndarray

    def probed(self, v: np.ndarray, sizes: np.ndarray, need: int) -> list[np.ndarray]:
        """The lists that each query probes, nearest first: its number of probes, and on until they hold so many rows."""
        near = self.turned(v) @ self.centres.T
        order = np.argsort(-near, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        full = (held < need).sum(axis=1) + 1
        depth = np.maximum(self.probes, self.depths[np.searchsorted(self.edges, near.max(axis=1), side="right")])
        return [o[:n].astype(np.int32) for o, n in zip(order, np.maximum(depth, full), strict=True)]

    def first_bounds(self, v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Of each query its k-th least squared distance to the seeds, its own row left out; infinite where there are fewer."""
        out = np.full(len(v), np.inf)
        if len(self.seeds) <= k:
            return out
        for at in range(0, len(v), 256):
            d = 2 - 2 * self.turned(v[at : at + 256]) @ self.seeds.T
            d[ids[at : at + 256, None] == self.seed_ids] = np.inf
            out[at : at + 256] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out

    def turned(self, v: np.ndarray) -> np.ndarray:
        """Unit vectors, rotated."""
        return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.rotation


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of doubles) of the rows that may take part, of any length."""
    rows = columns(vectors, id=id_col, v=vector_col).where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return rows.where("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def best_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; a row's value doesn't depend on the other rows."""
    dots = np.add.reduce(x * y, axis=1)
    return dots / (np.sqrt(np.add.reduce(x * x, axis=1)) * np.sqrt(np.add.reduce(y * y, axis=1)))


def fit(sample: np.ndarray, ids: np.ndarray, rows: int, k: int, s: Settings) -> Index:
    r = np.random.default_rng(s.seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(r.standard_normal((d, d)))[0]
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ rotation
    lists = int(np.clip(round(rows**0.5 / 4), 1, max(1, len(x) // 16)))
    centres = x[r.choice(len(x), lists, replace=False)]
    for _ in range(10):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    of = (x @ centres.T).argmax(axis=1)
    asked = x[r.choice(len(x), min(1024, len(x)), replace=False)]
    place, partial = [], []
    cuts = range(s.step, d, s.step)
    for i in range(0, len(asked), 64):
        part = asked[i : i + 64]
        near = np.argsort(-(part @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        order = np.argsort(np.argsort(-(part @ centres.T), axis=1), axis=1)  # place of each list in each query's order
        place.append(np.take_along_axis(order, of[near], axis=1))
        gap = ((part[:, None] - x[near]) ** 2).reshape(-1, d)
        gap = gap[(total := gap.sum(axis=1)) > 1e-12]
        partial.append(np.cumsum(gap, axis=1)[:, [c - 1 for c in cuts]] / total[total > 1e-12, None])
    place, partial = np.concatenate(place), np.concatenate(partial)
    shares = np.quantile(partial, 1 - s.alpha / len(cuts), axis=0, method="higher") if len(partial) and len(cuts) else np.ones(len(cuts))

    def least(p: np.ndarray) -> int:
        return min(lists, int(np.quantile(p, s.aim, method="higher")) + 1) if p.size else lists

    # The furthest 1/64 of the sampled queries, then as many again as all before, and so on.
    far = (asked @ centres.T).max(axis=1)
    by = np.argsort(far, kind="stable")
    split = [len(by) >> j for j in range(6, 0, -1) if len(by) >> j >= 8]
    depths = np.array([least(place[p]) for p in np.split(by, split)])
    few = min(s.seeds, len(x) // 4)  # so that about four times k rows of the sample lie within a first bound
    return Index(rotation, centres, least(place), far[by[split]], depths, shares, x[:few], ids[:few])


def scan(x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, first: np.ndarray, k: int, index: Index, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the block for each query: (row of y, id, cosine); and how many candidates each column block was read for. x, y:
    original vectors; first: the queries' first bounds."""
    rx, ry = index.turned(x).astype(np.float32), index.turned(y).astype(np.float32)
    d = rx.shape[1]
    cuts = [slice(i, min(d, i + s.step)) for i in range(0, d, s.step)]
    held = [np.ascontiguousarray(rx[:, c]) for c in cuts]  # column blocks
    asked = [np.ascontiguousarray(ry[:, c]) for c in cuts]
    x2, y2 = ([(b * b).sum(axis=1) for b in z] for z in (held, asked))
    share = np.r_[index.shares, 1.0].astype(np.float32)
    read = np.zeros(len(cuts), np.int64)
    out = []
    for at in range(0, len(y), 256):
        q = slice(at, min(len(y), at + 256))
        bound = first[q].copy()
        best = np.full((len(bound), k), np.inf)  # the k least distances so far
        got = [[np.zeros(0, np.int64)] * 2]
        for lo in range(0, len(x), s.rows):
            i, j = np.arange(q.start, q.stop), np.arange(lo, min(len(x), lo + s.rows))
            part, live, pairs = np.zeros((len(i), len(j)), np.float32), np.ones((len(i), len(j)), bool), None
            live[own[i][:, None] == ids[j]] = False
            for c in range(len(cuts)):
                limit = (bound * share[c]).astype(np.float32) + np.float32(1e-5)
                if pairs is None:
                    read[c] += np.count_nonzero(live)
                    part += y2[c][i][:, None] + x2[c][j] - 2 * (asked[c][i] @ held[c][j].T)
                    live &= part <= limit[i - at][:, None]
                    left = np.count_nonzero(live)
                    if left * 8 < live.size:
                        a, b = np.nonzero(live)
                        pairs, p = (i[a], j[b]), part[a, b]
                    else:
                        rows, cols = live.any(axis=1), live.any(axis=0)
                        if rows.mean() < 0.9 or cols.mean() < 0.9:
                            i, j, part, live = i[rows], j[cols], part[np.ix_(rows, cols)], live[np.ix_(rows, cols)]
                else:
                    a, b = pairs
                    read[c] += len(a)
                    p = p + ((asked[c][a] - held[c][b]) ** 2).sum(axis=1)
                    keep = p <= limit[a - at]
                    pairs, p = (a[keep], b[keep]), p[keep]
            if pairs is None:
                a, b = np.nonzero(live)
                pairs, p = (i[a], j[b]), part[a, b]
            a, b = pairs
            got.append([a, b])
            if len(a):
                # The k-th least distance of each query so far bounds what may still come; single precision gets its margin.
                order = np.lexsort((p, a))
                a, p = a[order] - at, p[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                few = rank < k
                new = np.full(best.shape, np.inf)
                new[a[few], rank[few]] = p[few]
                best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
                bound = np.minimum(bound, best[:, -1] + 1e-5)
        i, j = (np.concatenate([g[n] for g in got]) for n in (0, 1))
        score = best_cosines(y[i], x[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[top], ids[j[top]], score[top]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return (*(tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else none), read)


def search(vectors: DataFrame, asked: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of asked its k nearest rows of vectors but its own."""
    s = settings or Settings()
    spark = vectors.sparkSession
    bounded_batches(spark)
    every = usable(vectors, id_col, vector_col)
    lengths = {r["n"]: r["count"] for r in every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()}
    length, rows = next(iter(lengths.items()), (0, 0))
    base = every.where(F.size("v") == length)
    scale = 1 << 30
    drawn = base.withColumn("h", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)))
    share = min(scale, int(scale * (s.sample + 4 * s.sample**0.5 + 4) / max(1, rows)))
    got = drawn.where(F.col("h") < share).orderBy("h", "id").limit(s.sample).toPandas()
    if got.empty and rows:
        got = drawn.orderBy("h", "id").limit(s.sample).toPandas()
    if got.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(np.stack(got["v"].to_numpy()), got["id"].to_numpy(), rows, k, s)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        ix = shared.value
        return pd.Series((ix.turned(np.stack(v.to_numpy())) @ ix.centres.T).argmax(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    placed = written(base.select("id", "v", nearest("v").alias("list")), "lists")
    per_list = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row a list
    held_by = np.array([per_list.get(n, 0) for n in range(len(index.centres))])

    @F.pandas_udf("array<int>")
    def probed(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probed(np.stack(v.to_numpy()), held_by, s.spare * (k + 1)) if len(v) else [], dtype=object)

    @F.pandas_udf("double")
    def bounded(v: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(shared.value.first_bounds(np.stack(v.to_numpy()), ids.to_numpy(), k) if len(v) else np.zeros(0))

    queries = usable(asked, id_col, vector_col).where(F.size("v") == length)
    queries = written(queries.select("id", "v", probed("v").alias("probes"), bounded("v", "id").alias("first")), "probes")
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(4)), F.col(n)).cast("int")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        own = y["id"].to_numpy()
        i, ids, score, _ = scan(np.stack(x["v"].to_numpy()), x["id"].to_numpy(), np.stack(y["v"].to_numpy()), own, y["first"].to_numpy(), k, shared.value, s)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": score})

    def answers(queries: DataFrame) -> DataFrame:
        per_probe = {r["list"]: r["count"] for r in queries.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
        sizes = [(n, -(-per_list[n] // s.block), -(-per_probe[n] // s.portion)) for n in per_list if n in per_probe]
        shape = F.broadcast(spark.createDataFrame(sizes, "list int, blocks int, portions int"))
        held = placed.join(shape, "list").select("id", "v", "list", mine("blocks").alias("block"), F.explode(F.expr("sequence(0, portions - 1)")).alias("portion"))
        sent = queries.select("id", "v", "first", F.explode("probes").alias("list")).join(shape, "list").select("id", "v", "first", "list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), mine("portions").alias("portion"))
        key = ["list", "block", "portion"]
        found = held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(answers(queries), "near")
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.where(F.size("probes") < len(held_by)).join(enough, "id", "left_anti")
    if short.isEmpty():
        return first
    every_list = F.sequence(F.lit(0), F.lit(len(held_by) - 1))
    short = written(short.withColumn("probes", every_list).withColumn("first", F.lit(float("inf"))), "short")
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(answers(short))


def digest(vectors: DataFrame) -> DataFrame:
    """The query's rows: asks with every row whose id is divisible by 50."""
    return search(vectors, vectors.where("vec_id % 50 = 0"))
