"""Connected components of a graph given as edges, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: The edges of a node are dealt into at most so many parts, which meet its least neighbour apart from each other.
PARTS = 1024


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges with the least m of their u and its neighbours. edges: u, v and part, from 0 to PARTS - 1. The least comes from sums
    that are partial before the shuffle and goes to each part that the node has, so a hub fills no task. Nothing is broadcast: each
    broadcast would take memory of the driver, in every round."""
    per = edges.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("part").alias("parts"))
    least = per.select("u", F.explode("parts").alias("part"), F.least("u", "m").alias("m"))
    return edges.join(least.hint("merge"), ["u", "part"]).select("u", "v", "m")


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int").alias("part")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root: the least node of its component. edges: (u, v), any order, repeats allowed.

    Alternates large-star and small-star until nothing changes (some log squared rounds). Each round is checkpointed to the shared
    folder. Nodes may be of any type that has an order, structs too.

    Defined results: an edge from a node to itself, and a repeated one, changes nothing; nodes are not null; no edges give no rows.
    """
    shared_dir(edges.sparkSession)

    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = df.checkpoint()
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now, sign = checked(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while sign[0]:
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _with_least(both.select("u", "v", _part("v"))).where("v > u")
        # Neighbours of one node may bring it the same edge: each brings a part of its own.
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"), _part("u"))
        small = _with_least(large).select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        after, to = checked(small.where("u <> v").distinct())
        if to == sign:
            break
        now, sign = after, to
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
