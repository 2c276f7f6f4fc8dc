"""Corpus cleaning pipeline: stages applied one after the other to the documents table.

A document is known by its doc_id: rows that repeat an id share one decision, rows without an id are
never dropped by a comparison. A null text counts as empty: it is not toxic of its own, a copy of other empty
texts, and has no benchmark words. Every stage but the last returns the columns that it was given, whatever
their names; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateledger.llm import toxicity
from slateledger.llm.common import own_dir, table
from slateledger.llm.decontam import decontaminate
from slateledger.llm.exact import exact_dedup
from slateledger.llm.packing import pack_sequences
from slateledger.llm.simhash import simhash_dedup


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped (doc_id); a hash or merge join, as Spark finds best."""
    gone = dropped.where("doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, scores below a half; row by row, also
    those without an id. Without both labels among them all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(docs, model) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest; of equals the smallest id."""
    return without(docs, exact_dedup(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the one with the smallest id."""
    return without(docs, simhash_dedup(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without(docs, found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences; a row without an id is packed like any other."""
    return pack_sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the model nor the fingerprints; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
