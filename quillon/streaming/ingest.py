"""Appending series to a tree index as they arrive: every micro-batch is routed to its leaves and appended once, and the sketches of all nodes
it passes are widened, so that searches of the index stay exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tree as trees


def append(batch: DataFrame, batch_id: int, tree: trees.Tree, path: str) -> None:
    """Writes the batch under its own number, sorted by leaf, after what it changes in the nodes' sketches: a batch that is run again
    replaces what it wrote, and who reads in between has sketches that are wider than need be. ``tree.read`` reads all."""
    trees.synopsis(batch, tree).write.mode("overwrite").parquet(f"{path}/synopsis/batch={batch_id}")
    rows = trees.assigned(batch, tree).sortWithinPartitions("leaf_id", "vec_id")
    rows.write.mode("overwrite").parquet(f"{path}/series/batch={batch_id}")


def start(stream: DataFrame, tree: trees.Tree, path: str, checkpoint: str):
    """The streaming query that keeps the index at ``path`` up to date; stop it as any other."""
    return stream.writeStream.foreachBatch(lambda batch, n: append(batch, n, tree, path)).option("checkpointLocation", checkpoint).start()


def overfull(series: DataFrame, leaf_size: int) -> DataFrame:
    """leaf_id, n of the leaves that have grown past leaf_size and should be split by a new build."""
    return series.groupBy("leaf_id").agg(F.count("*").alias("n")).where(F.col("n") > leaf_size)
