"""Names for SQL: series functions, and a table function that searches a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DoubleType, LongType, StructType

from . import arrays

#: Bodies of SQL functions over series; they are inlined by the planner.
BODIES = {
    "series_mean": ("v ARRAY<DOUBLE>", "DOUBLE", "aggregate(v, 0D, (a, x) -> a + x) / size(v)"),
    "series_sd": ("v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (a, x) -> a + (x - series_mean(v)) * (x - series_mean(v))) / size(v))"),
    "series_znorm": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(v, x -> CASE WHEN series_sd(v) > 1e-12 THEN (x - series_mean(v)) / series_sd(v) ELSE 0D END)"),
    "series_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "series_paa": ("v ARRAY<DOUBLE>, segments INT", "ARRAY<DOUBLE>", "transform(sequence(0, segments - 1), i -> aggregate(slice(v, i * (size(v) div segments) + 1, size(v) div segments), 0D, (a, x) -> a + x) / (size(v) div segments))"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions above and ``dtw_distance(a, b, band)`` known to the session."""
    for name, (params, out, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {out} RETURN {body}")

    @F.pandas_udf("double")
    def dtw_distance(a: pd.Series, b: pd.Series, band: pd.Series) -> pd.Series:
        return pd.Series([float(arrays.dtw(np.array([x], float), np.array(y, float), int(r))[0] ** 0.5) for x, y, r in zip(a, b, band, strict=True)])

    spark.udf.register("dtw_distance", dtw_distance)
    spark.udtf.register("nearest", _nearest())


def _nearest():
    """``nearest(TABLE(t) PARTITION BY ..., array(...), k)``: vec_id and dist of the k nearest rows of each partition to a vector. The
    table's columns are vec_id and v."""
    from pyspark.sql.functions import udtf

    @udtf
    class Nearest:
        def __init__(self):
            self.held: list[tuple[float, int]] = []
            self.k = 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, q: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=StructType().add("vec_id", LongType()).add("dist", DoubleType()))

        def eval(self, row, q, k: int):
            self.k = k
            d = float(np.linalg.norm(np.array(row["v"], float) - np.array(q, float)))
            self.held.append((d, row["vec_id"]))
            if len(self.held) > 4 * k + 64:
                self.held = sorted(self.held)[:k]

        def terminate(self):
            for d, i in sorted(self.held)[: self.k]:
                yield i, d

    return Nearest


def knn(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The join as a function, for ``df.transform``."""
    from ..operators.knn import knn_join

    return knn_join(data, queries, k)
