"""A corpus from raw documents to packed sequences, in five stages, each written and read again as the next one's documents.

1. toxicity: documents that the network rejects go.
2. near_duplicates: one document of each SimHash group stays.
3. decontamination: contaminated documents go.
4. secrets: every span found is masked; documents stay.
5. packing: the documents' ids are packed; gives a row for each piece.

Defined results: null and empty texts are judged as such (the empty text is trained as clean, has fingerprint zero, no words, no secrets and
one separator), so one document without words stays; of repeated rows one stays; rows without an id, or with one id and different texts, are
documents of their own; ids may be of any type that has an order; empty tables give no rows; further columns, whatever their names, pass
through the filtering stages unchanged. Each stage's table goes when the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, packing, secrets, simhash, toxicity
from quillon.llm.common import discard, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained network, connected components, a test battery and a packing plan: SQL doesn't express them; tests/llm holds run() against plain
#: versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        after = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            after = written(after, f"pipeline-{name}")
            discard(docs)
        docs = after
    return docs
