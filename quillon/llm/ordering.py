"""Token-id output in training order: a keyed Feistel permutation gives every sequence a global slot, and shards hold ranges of slots.

1. Documents are dealt into ranges by a hash of id and text, about ``RANGE_ROWS`` to a range, and sorted by it, so that what follows doesn't
   depend on how Spark splits the input: another run, or one on other machines, gives the same sequences in the same slots.
2. A task turns the documents of a range into ids, each document closed by an end mark, and cuts the stream into sequences of ``length`` ids
   (the last of a range is filled up with end marks). Chunks of sequences are written once, compressed, to the shared folder. All chunks of
   a range but its last hold as many sequences, so a sequence's number follows from its range's base, chunk and place. Bases are a running
   sum over one count a range.
3. Number n goes to slot P(n), where P is a balanced Feistel network on the least even number of bits that holds all numbers, applied again
   until the result is below their count (cycle-walking): a bijection that needs no table, no shuffle of keys and no state, and can be
   inverted. Another key gives another epoch's order.
4. Rows are dealt by shard, slots // rows a shard, which for a permutation are even ranges. A task sorts its slots and writes one file of
   fixed stride, little-endian 16-bit ids: slot s lies in shard s // rows at byte (s % rows) * stride. A reader streams shards in order and
   resumes at any slot by a seek.

Files are written under an attempt's name and moved, so a repeated task replaces a file by an equal one.

Defined results: null and empty texts contribute their end mark; no documents give no sequences; repeated rows are kept, side by side; null
ids are an id like others; a vocabulary with ids beyond 16 bits is refused; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_batches, columns, fresh_dir, written

END = 50256
CHUNK = 256
#: Documents of a range, on average, and ranges at most: a range is a task.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 15
#: Ranges up to which their bases, 12 bytes each, are broadcast; beyond, they are joined by a shuffle.
MOST_TASKS = 1_000_000
#: Ids of one chunk help to compress the single sequences on their way to the shards.
DICTIONARY_BYTES, LEVEL = 1 << 16, 6


@dataclass(frozen=True)
class Permutation:
    """Of the numbers below n, by key."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _mix(self, x: np.ndarray, round_: int) -> np.ndarray:
        x = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (round_ + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        a, b = x >> np.uint64(self.half), x & low
        for r in range(self.rounds - 1, -1, -1) if back else range(self.rounds):
            a, b = (b ^ self._mix(a, r), a) if back else (b, a ^ self._mix(b, r))
        return (a << np.uint64(self.half)) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        x = self._once(x, back)
        while (over := x >= np.uint64(self.n)).any():
            x[over] = self._once(x[over], back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    folder: str
    sequences: int
    length: int
    rows: int

    @property
    def stride(self) -> int:
        return 2 * self.length

    def file(self, shard: int) -> str:
        return f"shard-{shard:08d}.bin"


def chunks(docs: DataFrame, length: int, *, id_col: str = "doc_id", text_col: str = "text", json_path: str = tokens.JSON, ranks_path: str = tokens.RANKS) -> DataFrame:
    """part, chunk, sequences, filled (ids that only fill up), ids (compressed)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, pack = tokens.encoder(json_path, ranks_path).ids, zstandard.ZstdCompressor(level=LEVEL)
        part, chunk, held, n, full = TaskContext.get().partitionId(), 0, [], 0, CHUNK * length  # a partition is a range

        def row(ids: np.ndarray, filled: int) -> tuple:
            return part, chunk, len(ids) // length, filled, pack.compress(ids.tobytes())

        names = ["part", "chunk", "sequences", "filled", "ids"]
        for batch in batches:
            for text in batch["text"]:
                ids = np.append(encode(text), np.uint32(END))
                if ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} doesn't fit into 16 bits")
                ids = ids.astype("<u2")
                held.append(ids)
                n += len(ids)
                if n >= full:
                    ids = np.concatenate(held)
                    rows = []
                    while len(ids) >= full:
                        rows.append(row(ids[:full], 0))
                        chunk, ids = chunk + 1, ids[full:]
                    held, n = [ids], len(ids)
                    yield pd.DataFrame(rows, columns=names)
        if n:
            filled = -n % length
            yield pd.DataFrame([row(np.concatenate([*held, np.full(filled, END, "<u2")]), filled)], columns=names)

    rows = columns(docs, id=id_col, text=text_col)
    ranges = min(MOST_RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    keyed = rows.select("id", "text", F.xxhash64("id", "text").alias("h")).withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int"))
    ordered = keyed.repartitionById(ranges, "range").sortWithinPartitions("h", "id", F.xxhash64("text", F.lit(5)))
    return ordered.select("text").mapInPandas(run, "part int, chunk int, sequences int, filled int, ids binary")


def materialise(docs: DataFrame, folder: str, *, key: int, length: int = 2048, shard_bytes: int = 16 << 20, **options) -> tuple[DataFrame, Layout]:
    """The table (sequence, slot, shard, start, n_tokens, ids_crc32) whose evaluation writes the shards, and their layout."""
    spark = docs.sparkSession
    held = written(chunks(docs, length, **options), "chunks")
    per = held.groupBy("part").agg(F.sum("sequences").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    layout = Layout(folder, total, length, max(1, shard_bytes // (2 * length)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the first step
    bases = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if per.count() <= MOST_TASKS:
        bases = F.broadcast(bases)
    first = held.select("ids").first()
    words = zstandard.decompress(first["ids"])[:DICTIONARY_BYTES] if first else b""
    order = Permutation(total, key)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(unpack.decompress(r.ids), "<u2").reshape(-1, length)
                number = r.base + r.chunk * CHUNK + np.arange(len(ids))
                slot = order.slot(number)
                n = np.full(len(ids), length)
                n[-1:] -= r.filled
                yield pd.DataFrame({"shard": (slot // layout.rows).astype(np.int32), "slot": slot, "sequence": number, "n_tokens": n.astype(np.int32), "ids": [pack.compress(x.tobytes()) for x in ids]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        unpack, out, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)), None, None
        shard, attempt = None, TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if out is None:
                    store.create_dir(path, recursive=True)
                    shard, at = r.shard, r.shard * layout.rows
                    out = store.open_output_stream(f"{path}/{layout.file(shard)}.{attempt}", compression=None)
                if r.slot != at:
                    raise ValueError(f"slot {r.slot} comes where {at} is due")
                ids = unpack.decompress(r.ids)
                out.write(ids)
                rows.append((r.sequence, r.slot, shard, (at - shard * layout.rows) * layout.stride, r.n_tokens, zlib.crc32(ids)))
                at += 1
            yield pd.DataFrame(rows, columns=["sequence", "slot", "shard", "start", "n_tokens", "ids_crc32"])
        if out is not None:
            out.close()
            store.move(f"{path}/{layout.file(shard)}.{attempt}", f"{path}/{layout.file(shard)}")

    dealt = held.join(bases, "part").mapInPandas(deal, "shard int, slot long, sequence long, n_tokens int, ids binary")
    ordered = dealt.repartitionById(max(1, -(-total // layout.rows)), "shard").sortWithinPartitions("slot")
    return ordered.mapInPandas(write, "sequence long, slot long, shard int, start long, n_tokens int, ids_crc32 long"), layout


def read(layout: Layout, slot: int, n: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on: sequential reads after one seek."""
    store, path = pafs.FileSystem.from_uri(layout.folder)
    end = layout.sequences if n is None else min(layout.sequences, slot + n)
    while slot < end:
        shard = slot // layout.rows
        with store.open_input_file(f"{path}/{layout.file(shard)}") as f:
            f.seek((slot - shard * layout.rows) * layout.stride)
            for _ in range(min(end, (shard + 1) * layout.rows) - slot):
                yield np.frombuffer(f.read(layout.stride), "<u2")
                slot += 1


def digest(spark: SparkSession, docs: DataFrame, key: int = 1) -> DataFrame:
    return materialise(docs, fresh_dir(spark, "shards"), key=key)[0]
