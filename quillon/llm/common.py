"""What the operators of this subpackage share: sessions, shared folders, packing of numbers into bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: what a Python worker holds at once, unless a single row is larger.
BATCH_BYTES = 8 << 20
#: A key with more than one in so many of all rows is hot: there are fewer such keys than this, whatever the data.
HOT = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what Python workers hold by bytes. It is one value for all operators, so plans may run in any order after they are built."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = getattr(shared_dir, "own", None)
        if d is None:
            own = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            d = shared_dir.own = f"file://{own}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors. The table goes when the driver ends, or by
    ``discard``; the shuffles that made it go at once."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    early = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(early)
    spark.conf.set(early, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(early, before)
    store, at = _store(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, when nothing reads it any more."""
    if path := getattr(df, "written_to", None):
        store, at = _store(df.sparkSession, path)
        store.delete(at, True)


def joined_hot(rows: DataFrame, classes: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows with the columns of classes: one row for each key, and in ``size`` how many rows have it. Hot keys are broadcast, a proven bound,
    so that none of them fills a task; the others meet by a shuffle. Both tables are read twice and should be written ones."""
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT > total
    often = classes.where(hot)
    seldom = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(classes.where(~hot), key, how)
    return rows.join(F.broadcast(often), key).unionByName(seldom)


def gathered(df: DataFrame, parts: int = 16) -> Iterator:
    """The rows of a small result of a large scan, one after another. The shuffle lets the scan run in parallel: without it each
    partition of the scan would be a job of its own, one after another."""
    return df.repartition(parts).toLocalIterator()


def columns(docs: DataFrame, **needed: str) -> DataFrame:
    """Only the columns an operator needs, under its own names: name=column. Other columns can't clash with what it adds."""
    return docs.select(*[F.col(f"`{column}`").alias(name) for name, column in needed.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of the value as text, modulo; null for a null value."""
    return F.crc32(F.col(column).cast("string")) % modulus


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
