"""The corpus pipeline: five stages over documents, each written and read again before the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
Decisions are made by a row key that every row has: its id, or for rows without one a hash of source and text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.decontaminate import contaminated
from maskwright.llm.language import without_unknown
from maskwright.llm.minhash import near_duplicates
from maskwright.llm.mixing import mixed_documents
from maskwright.llm.pii import sanitise
from maskwright.session import materialize, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null texts, texts without letters) go. Ambiguous ones stay."""
    return without_unknown(docs.select(*COLUMNS))


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with `key`: the id, or for rows without one a hash above all usual ids, so that rows with ids go first."""
    made = F.shiftrightunsigned(F.xxhash64("source", F.col("source").isNull(), "text", F.col("text").isNull()), 2).bitwiseOR(F.lit(1 << 62))
    return docs.select(*COLUMNS).withColumn("key", F.when(F.col("doc_id").isNull(), made).otherwise(F.col("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays: the one with the smallest key. Of rows that repeat its key, one stays."""
    docs = with_key(docs)
    kept, _ = materialize(near_duplicates(docs, percent=80, id_col="key").where("kept").groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    once = docs.join(kept.where("n = 1"), "key", "left_semi")
    repeated = docs.join(kept.where("n > 1"), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(repeated).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    docs = with_key(docs)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    held, _ = materialize(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct())
    return docs.join(held, "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are replaced by what they are; n_chars follows the text."""
    return sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, and how often (`repeats`)."""
    return mixed_documents(docs.select(*COLUMNS))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", personal_data), ("mix", mix)]
#: Trained classifiers, digests and seeded choices are beyond SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
