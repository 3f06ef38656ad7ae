"""SimHash near-duplicate groups by a self-join of binary tries.

A 64-bit fingerprint is the majority of the XXH64 bits of a text's word 4-shingles. Documents with equal fingerprints are one class from
then on; classes whose fingerprints differ in at most 4 bits are linked, and linked classes are one component.

The join: 64 bits are cut into blocks, five or more, so that fingerprints within 4 bits agree in all but four of them at least. For each
choice of the blocks that agree the classes are dealt out by those bits; classes that agree there form one binary trie over the other
bits. There are five blocks, and so five deals, until even groups would pass ``most``; then a block more. The trie is joined with itself
from the root down: pairs of nodes descend together, a pair on different branches has one more differing bit, and a pair over the budget
of 4 is pruned. A path without branches is one edge, so two single classes are told by the bits that are left. Pairs of nodes are
handled a portion of one level at a time, depth first, so that memory is bounded. A task keeps the forest of its links, not the links,
so that a dense group of m classes gives m - 1 edges. A trie with more than ``most`` classes is cut into blocks by hash, and every two of
its blocks meet in a task.

A class is a node (no id, least id, fingerprint), so that the least node of a component, which ``graph.components`` gives, has its name.

Defined results: texts without words, and null texts, have fingerprint zero and are linked like any other; repeated rows have equal
results; a component of null ids only has a null id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, joined_hot, unused, written
from .graph import components

SHINGLE, SEED, BUDGET, BITS = 4, 42, 4, 64
MOST = 4096
#: Rows that one task of the join gets, on average and at most.
TASK_ROWS = 500_000
#: Pairs of nodes that descend at once.
PORTION = 1 << 18


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1].tolist()
    last = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(first)
    for i in range(0, n, 1 << 15):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[i : i + (1 << 15)], last[i : i + (1 << 15)], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_key(text_col: str):
    """What tells the texts of rows with one id apart."""
    return F.struct(F.xxhash64(text_col).alias("hash"), F.coalesce(F.length(text_col), F.lit(-1)).alias("length"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; keys: and key, the text's."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))

    return columns(docs, doc_id=id_col, text=text_col).select("doc_id", run("text").alias("fp"), *([text_key("text").alias("key")] if keys else []))


def blocks(classes: int, most: int = MOST) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest blocks by which evenly spread fingerprints fall into groups of at most ``most``."""
    n = BUDGET + 1
    while n < 2 * BUDGET and classes > most << ((n - BUDGET) * (BITS // n)):
        n += 1
    sizes = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(BITS - sum(sizes[: i + 1]), size) for i, size in enumerate(sizes)]


def joined_trie(group: np.ndarray, rest: np.ndarray, bits: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges (from, to), as places, of a forest that links, within each group, whatever differs in at most budget bits; and the number of
    pairs of nodes visited. group, rest: by class; rest: the low ``bits`` that tell the classes of a group apart."""
    order = np.lexsort((rest, group))
    group, rest = group[order], rest[order]
    parent = np.arange(len(rest))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(group)] if len(group) else starts
    many = ends - starts > 1
    visited = 0

    def link(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = parent[i], parent[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
            while (up := parent[parent]) is not None and (up != parent).any():
                parent[:] = up

    def portions(bit: int, *pairs: np.ndarray) -> list[tuple[int, tuple[np.ndarray, ...]]]:
        return [(bit, tuple(x[at : at + PORTION] for x in pairs)) for at in range(0, len(pairs[0]), PORTION)]

    todo = portions(bits - 1, starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64))
    while todo:
        bit, (a0, a1, b0, b1, err) = todo.pop()
        visited += len(a0)
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = err[single] + np.bitwise_count((rest[i] ^ rest[j]) & np.uint64((1 << (bit + 1)) - 1)) <= budget
        link(i[near], j[near])
        a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if bit < 0:  # only repeated classes come here; all are within the budget
            for k in range(len(a0)):
                link(np.arange(a0[k], a1[k]), np.full(a1[k] - a0[k], b0[k]))
                link(np.arange(b0[k], b1[k]), np.full(b1[k] - b0[k], a0[k]))
            continue
        # Where each range goes over from 0 to 1 at this bit: rest is sorted within a node.
        am, bm = _turn(rest, bit, a0, a1), _turn(rest, bit, b0, b1)
        other = a0 != b0
        pairs = [
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (err, err, err + 1, err[other] + 1),
            )
        ]
        a0, a1, b0, b1, err = pairs
        keep = (a0 < a1) & (b0 < b1) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        todo += portions(bit - 1, *(x[keep] for x in pairs))
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return order[moved], order[parent[moved]], visited


def _turn(rest: np.ndarray, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place of each range whose bit is set, by binary search in all ranges at once."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = open_ & ((rest[np.minimum(mid, len(rest) - 1)] & mask) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _rest(fps: np.ndarray, cut: list[tuple[int, int]], agree: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, (low, n) in enumerate(cut):
        if k not in agree:
            out = (out << np.uint64(n)) | ((fps >> np.uint64(low)) & np.uint64((1 << n) - 1))
    return out


def links(classes: DataFrame, most: int = MOST, cut: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges (u, v) between nodes (none, id, fp) of a forest of all links. classes: fp, none (whether the least id is missing) and id of each
    fingerprint."""
    spark = classes.sparkSession
    n = classes.count()
    cut = cut or blocks(n, most)
    agree = list(combinations(range(len(cut)), len(cut) - BUDGET))

    def key(which: tuple[int, ...]) -> str:
        out = "0L"
        for k in which:
            out = f"(shiftleft({out}, {cut[k][1]}) | (shiftrightunsigned(fp, {cut[k][0]}) & {(1 << cut[k][1]) - 1}))"
        return out

    dealt = classes.select("fp", "none", "id", F.expr("inline(array(" + ", ".join(f"struct({d} AS deal, {key(w)} AS bits)" for d, w in enumerate(agree)) + "))"))
    heavy = dealt.groupBy("deal", "bits").count().where(F.col("count") > most).select("deal", "bits", F.ceil(F.col("count") / most).cast("int").alias("cuts"))
    parted = dealt.join(heavy, ["deal", "bits"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1))).cast("int"))
    met = parted.withColumn("other", F.explode(F.expr("sequence(0, coalesce(cuts, 1) - 1)")))
    tasks = met.select("fp", "none", "id", "deal", "bits", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(agree) * n // TASK_ROWS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for deal, part in rows.groupby("deal"):
            group = part.groupby(["bits", "lo", "hi"], sort=False).ngroup().to_numpy()
            part, group = part[(met := np.bincount(group)[group] > 1)], group[met]
            fps = part["fp"].to_numpy().view(np.uint64)
            which = agree[deal]
            u, v, _ = joined_trie(group, _rest(fps, cut, which), BITS - sum(cut[k][1] for k in which))
            yield pd.DataFrame({f"{side}_{c}": part[c].to_numpy()[at] for side, at in (("u", u), ("v", v)) for c in ("none", "id", "fp")})

    kind = dict(classes.dtypes)["id"]
    edges = tasks.repartition(parts, "deal", "bits", "lo", "hi").mapInPandas(run, ", ".join(f"{s}_none boolean, {s}_id {kind}, {s}_fp long" for s in "uv"))
    return edges.select(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("none", "id", "fp")]).alias(s) for s in "uv"])


def rooted(classes: DataFrame, most: int = MOST) -> DataFrame:
    """classes (fp, id and more) with the node root of each one's component: none (whether all its ids are missing), id (the least) and fp.
    A missing id stands as some other, so that ids pass through numpy as they are."""
    some = classes.agg(F.min("id").alias("id")).first()["id"]
    kind = dict(classes.dtypes)["id"]
    filled = F.coalesce("id", F.lit(some).cast(kind)).alias("id")
    nodes = classes.select("fp", F.col("id").isNull().alias("none"), filled)
    roots = components(links(nodes, most)).select(F.col("node.fp").alias("fp"), "root")
    own = F.struct(F.col("id").isNull().alias("none"), filled, "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", own))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id of the component) of every row."""
    marks = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    named = written(rooted(classes, most).select("fp", "n", F.when(~F.col("root.none"), F.col("root.id")).alias("component_id")), "components")
    return joined_hot(marks, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component, that with the smallest id (null only where all are), of these the least fingerprint and hash of
    its text; the same columns. A row is known by id and text, so rows that share an id, or have none, are kept or left each for its own
    component."""
    marks = written(fingerprints(docs, id_col=id_col, text_col=text_col, keys=True), "fingerprints")
    rows = marks.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    heads = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("head"))
    classes = written(heads.select("fp", F.col("head.doc_id").alias("id"), F.col("head.key").alias("key"), F.col("head.n").alias("n")), "classes")
    id_, key, n = (unused(docs, f"_keep_{c}") for c in ("id", "key", "n"))
    keep = rooted(classes).where("root.fp = fp").select(F.col("id").alias(id_), F.col("key").alias(key), F.col("n").alias(n))
    keep = written(keep, "keep")
    mine = unused(docs, "_key")
    keyed = docs.withColumn(mine, text_key(f"`{text_col}`"))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(key))
    once = keyed.join(keep.where(F.col(n) == 1), on, "left_semi")
    again = keyed.join(keep.where(F.col(n) > 1), on, "left_semi").dropDuplicates([id_col, mine])
    return once.unionByName(again).drop(mine)
