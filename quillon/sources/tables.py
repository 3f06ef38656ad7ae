"""Series from tables: embeddings as they are, and events, orders and line items by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def normalised(df: DataFrame, column: str = "v") -> DataFrame:
    """df with the column z-normalised."""
    return df.withColumn(column, series.znorm(F.col(column)))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v: running sums of the embeddings, z-normalised."""
    return normalised(embeddings(spark, sf_dir).withColumn("v", series.running_sum(F.col("v"))))


def by_bucket(rows: DataFrame, key: str, bucket: str, value: str, length: int) -> DataFrame:
    """key, v: sums of value by bucket 0 to length - 1, missing ones 0. Sums come before the lists, so a list has length entries at most."""
    sums = rows.where(F.col(bucket).between(0, length - 1)).groupBy(key, bucket).agg(F.sum(value).alias("x"))
    lists = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(bucket, "x"))).alias("m"))
    return lists.select(key, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (user), v: the sum of values on each of 30 days."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "value")
    return by_bucket(e, "series_id", "day", "value", 30)


def _month(column: str):
    return (F.year(column) - 1995) * 12 + F.month(column) - 1


def order_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (nation of the customer), v: the sum of order prices in each of 80 months. Sums by customer come before the join."""
    o = table(spark, sf_dir, "orders").select("o_custkey", _month("o_orderdate").alias("month"), "o_totalprice")
    sums = o.groupBy("o_custkey", "month").agg(F.sum("o_totalprice").alias("x"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("series_id"))
    return by_bucket(sums.join(c, "o_custkey"), "series_id", "month", "x", 80)


def supplier_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (supplier), v: the sum of quantities shipped in each of 83 months."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), _month("l_shipdate").alias("month"), "l_quantity")
    return by_bucket(items, "series_id", "month", "l_quantity", 83)


def random_walks(spark: SparkSession, rows: int, length: int, seed: int, *, normalise: bool = True, repeat_every: int = 0) -> DataFrame:
    """vec_id, v: running sums of standard normal steps that depend on seed and id only; repeat_every n: every n-th series repeats the one
    before it."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            from_ = np.where(ids % repeat_every == repeat_every - 1, ids - 1, ids) if repeat_every else ids
            yield pd.DataFrame({"vec_id": ids, "v": [np.random.default_rng([seed, i]).standard_normal(length).cumsum() for i in from_.tolist()]})

    df = spark.range(rows).mapInPandas(run, "vec_id long, v array<double>")
    return normalised(df) if normalise else df


def parsed_text(df: DataFrame, column: str = "value", delimiters: str = r"[ ,\t]+") -> DataFrame:
    """df with a column v of the numbers in a text column."""
    return df.withColumn("v", F.transform(F.split(F.trim(F.col(column)), delimiters), lambda s: s.cast("double")))


def query_slice(queries: DataFrame, skip: int, size: int, id_col: str = "vec_id") -> DataFrame:
    """The queries of places skip to skip + size - 1 in the order of ids."""
    return queries.orderBy(id_col).offset(skip).limit(size)
