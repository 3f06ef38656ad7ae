"""Headerless files of 32-bit floats, series after series, and of 64-bit labels: data sources and a sink.

``spark.read.format("float_series").option("length", n).load(path)`` gives (vec_id, v), ``label_series`` gives (vec_id, label). The path is a
file, or a folder: files by the manifest that ``write`` leaves there, else all ``*.bin`` by name. Files are cut into ranges of whole
records, which tasks read by seeking; the id is the record's place, running on from file to file. Options ``skip`` and ``size`` take a slice.
Files are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and of one Arrow batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
MANIFEST = "_manifest.json"


def _open(path: str):
    store, at = pafs.FileSystem.from_uri(path)
    return store, at


class Records(InputPartition):
    """``count`` records of a file from the ``first`` on, whose id is ``id_``."""

    def __init__(self, file: str, first: int, count: int, id_: int):
        self.file, self.first, self.count, self.id_ = file, first, count, id_


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int):
        self.path, self.width = options["path"], width
        self.skip, self.size = int(options.get("skip", 0)), options.get("size")

    def files(self) -> list[tuple[str, int]]:
        """Path and number of records of each file, in order."""
        store, at = _open(self.path)
        info = store.get_file_info(at)
        if info.type != pafs.FileType.Directory:
            found = [info]
        elif store.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
            with store.open_input_stream(f"{at}/{MANIFEST}") as f:
                found = store.get_file_info([f"{at}/{name}" for name, *_ in json.loads(f.read())])
        else:
            found = sorted((x for x in store.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".bin")), key=lambda x: x.path)
        for x in found:
            if x.size is None or x.size % self.width:
                raise ValueError(f"{x.path} holds no whole number of records of {self.width} bytes")
        return [(x.path, x.size // self.width) for x in found]

    def partitions(self) -> list[Records]:
        files = self.files()
        total = sum(n for _, n in files)
        end = total if self.size is None else min(total, self.skip + int(self.size))
        step, out, base = max(1, PART_BYTES // self.width), [], 0
        for path, n in files:
            for i in range(max(self.skip, base), min(end, base + n), step):
                out.append(Records(path, i - base, min(step, min(end, base + n) - i), i))
            base += n
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        step = max(1, BATCH_BYTES // self.width)
        with store.open_input_file(partition.file) as f:
            f.seek(self.width * partition.first)
            for i in range(0, partition.count, step):
                n = min(step, partition.count - i)
                yield self.batch(pa.array(partition.id_ + i + np.arange(n)), f.read(self.width * n), n)

    def batch(self, ids: pa.Array, data: bytes, n: int) -> pa.RecordBatch:
        raise NotImplementedError


class SeriesReader(RecordReader):
    def batch(self, ids: pa.Array, data: bytes, n: int) -> pa.RecordBatch:
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (self.width // 4))
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(data, "<f4")))], names=["vec_id", "v"])


class LabelReader(RecordReader):
    def batch(self, ids: pa.Array, data: bytes, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(data, "<i8"))], names=["vec_id", "label"])


class FloatSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "float_series"

    def schema(self) -> str:
        return "vec_id long, v array<float>"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(dict(self.options), 4 * int(self.options["length"]))


class LabelSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_series"

    def schema(self) -> str:
        return "vec_id long, label long"

    def reader(self, schema) -> DataSourceReader:
        return LabelReader(dict(self.options), 8)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FloatSeries)
    spark.dataSource.register(LabelSeries)


def write(df: DataFrame, folder: str, *, id_col: str = "vec_id", vector_col: str = "v") -> list[tuple[str, int, int]]:
    """Writes a file a partition, ordered by id across files, and a manifest; (file, first id, series) of each, a row a partition. A file is
    named by its attempt, and the manifest names those of attempts that succeeded; so a repeated task leaves at most a file that nothing
    refers to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        name, n, first, out = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.bin", 0, None, None
        for batch in batches:
            if len(batch):
                out = out or store.open_output_stream(f"{at}/{name}", compression=None)
                first = int(batch["id"].iloc[0]) if first is None else first
                out.write(np.stack(batch["v"].to_numpy()).astype("<f4").tobytes())
                n += len(batch)
        if out:
            out.close()
            yield pd.DataFrame([(name, first, n)], columns=["file", "first", "series"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(run, "file string, first long, series long").collect()
    files = sorted(((r["file"], r["first"], r["series"]) for r in found), key=lambda x: (x[1], x[0]))
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{MANIFEST}") as f:
        f.write(json.dumps(files).encode())
    return files


def labels(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, label from a file, or a folder of files, of 64-bit integers in the order of the series, read by ranges."""
    register(spark)
    return spark.read.format("label_series").load(path)


def histogram(path: str) -> list[tuple[float, float]]:
    """(distance, cumulative share) of a distance histogram's file: the number of bins, then a pair for each, as text."""
    store, at = _open(path)
    with store.open_input_stream(at) as f:
        numbers = f.read().decode().split()
    bins, pairs = int(float(numbers[0])), list(map(float, numbers[1:]))
    if len(pairs) != 2 * bins:
        raise ValueError(f"{path} names {bins} bins and has {len(pairs) / 2:g}")
    return list(zip(pairs[::2], pairs[1::2], strict=True))
