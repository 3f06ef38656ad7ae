"""Best-fit packing of documents into fixed-length sequences, after Martello and Toth's dominance reduction.

A document's ids end with a separator. Longer ones are cut into pieces of the capacity, of which the first may be shorter. What is packed
is the *histogram* of piece lengths, at most ``capacity`` counts, so that the plan is made on the driver whatever the size of the corpus:

1. Dominance reduction, from the longest length down and until nothing more can be fixed: a length L with at most two others beside it
   in a sequence is joined with the one, two or no lengths that provably dominate every other choice (an exact filler; the largest that
   fits when only one fits, or when it is at least any pair; the best pair when it holds the largest that fits and the pairs between are
   too few or too long). All equal pieces are fixed at once.
2. Best-fit decreasing on the rest, again in bulk: equal pieces go to the fullest sequences with room.

The plan is a list of runs (length, ranks, first sequence, offset). Pieces are numbered within their length by a salted count (hash
buckets, then a running sum over buckets), so that a length that a third of all pieces have is no task of its own. The plan's runs are
broadcast: their number is bounded by the capacity's patterns, not by the rows.

Defined results: null and empty texts are one piece that holds the separator; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_batches, columns, written

CAPACITY, SEPARATOR = 2048, 0
#: Hash buckets within a length: this many, and more where a bucket would hold over BUCKET_ROWS pieces of all lengths.
BUCKETS, BUCKET_ROWS = 64, 200_000

Pattern = tuple[int, ...]


def dominance(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Fixes sequences in counts (number of pieces by length) and takes their pieces out."""
    cap, fixed = len(counts) - 1, []

    def fix(pattern: Pattern) -> None:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(int(counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= times * n
        fixed.append((pattern, times))

    again = True
    while again:
        again = False
        for size in range(cap, 0, -1):
            while counts[size] > 0 and (pattern := _dominant(counts, size)):
                fix(pattern)
                again = True
    return fixed


def _dominant(counts: np.ndarray, size: int) -> Pattern | None:
    """The lengths that, with this one, dominate every other sequence that holds it; None if the rules don't tell."""
    room = len(counts) - 1 - size
    rest = counts[: room + 1].copy()
    if size <= room:
        rest[size] -= 1
    there = np.flatnonzero(rest > 0)
    if not len(there):
        return (size,)
    largest = int(there[-1])
    if largest == room:
        return (size, largest)
    small = np.repeat(there[:3], np.minimum(rest[there[:3]], 3))[:3]  # the three smallest others
    fit = int(np.searchsorted(np.cumsum(small), room, side="right"))
    if fit <= 1:
        return (size, largest)
    if fit > 2:
        return None
    below = np.searchsorted(there, room - there, side="right") - 1  # the largest partner of each
    partner = np.where(below >= 0, there[np.maximum(below, 0)], 0)
    alone = (partner == there) & (rest[there] < 2)
    partner = np.where(alone, np.where(below >= 1, there[np.maximum(below - 1, 0)], 0), partner)
    sums = np.where(partner > 0, there + partner, 0)
    best = int(sums.max(initial=0))
    if largest >= best:
        return (size, largest)
    at = int(np.flatnonzero(sums == best)[-1])
    a, b = max(int(there[at]), int(partner[at])), min(int(there[at]), int(partner[at]))
    if a != largest:
        return None
    between = int(rest[b + 1 : a].sum())
    over = there[there >= b]
    two = np.repeat(over[:3], np.minimum(rest[over[:3]], 3))[:3]  # b itself and the two before it
    if between <= 1 or len(two) < 3 or size + int(two[1]) + int(two[2]) > size + room:
        return (size, a, b)
    return None


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of all that counts holds."""
    cap = len(counts) - 1
    open_: list[dict[Pattern, int]] = [{} for _ in range(cap + 1)]  # by room left
    for size in range(cap, 0, -1):
        left = int(counts[size])
        room = size
        while left:
            while room < cap and not open_[room]:
                room += 1
            pattern, n = next(iter(open_[room].items())) if open_[room] else ((), left)
            fill = room // size
            times, fill = (min(n, left // fill), fill) if left >= fill else (1, left)
            if open_[room]:
                if times == n:
                    del open_[room][pattern]
                else:
                    open_[room][pattern] = n - times
            to = open_[room - size * fill]
            grown = pattern + (size,) * fill
            to[grown] = to.get(grown, 0) + times
            left -= times * fill
    return [x for by in open_ for x in by.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(lengths, times) of all sequences."""
    c = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        c[size] = n
    return [x for x in (*dominance(c), *best_fit(c)) if x[1]]


def runs(patterns: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """length, rank (first of the run, within the length), sequence (of that rank), offset: one row for each place in each pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for size in pattern:
            rows.append((size, used.get(size, 0), sequence, at))
            used[size] = used.get(size, 0) + times
            at += size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of n ids."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, s + capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str = tokens.JSON, ranks_path: str = tokens.RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids, of every piece of every row."""
    bounded_batches(docs.sparkSession)
    more = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(json_path, ranks_path).ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), np.uint32(SEPARATOR)).astype("<u4")
                for k, (s, e) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), *([ids[s:e].astype(np.int32)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    kind = dict(docs.dtypes)[id_col]
    return columns(docs, doc_id=id_col, text=text_col).mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of docs, written once to the shared folder, with sequence_id and offset."""
    spark = docs.sparkSession
    cuts = written(pieces(docs, capacity=capacity, **options), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in cuts.groupBy("length").count().collect()}  # at most capacity rows
    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    salted = cuts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1).drop("_bucket", "_base")
    table = runs(plan(counts, capacity))
    shared = spark.sparkContext.broadcast(((table["length"].to_numpy() << 44) + table["rank"].to_numpy(), *(table[c].to_numpy() for c in ("rank", "sequence", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = shared.value
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    names = [c for c in cuts.columns]
    return ranked.withColumn("_place", place("length", "_rank")).select(*names, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))
