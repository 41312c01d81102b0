"""A corpus pipeline: each stage applies one operation to all that the stage before it kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
items go, live-looking secrets are masked in the texts, and the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import bpe, decontam, near_text, secrets, simhash, toxicity
from assaykit.llm.common import cut, forget, read, small_batches


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.assess(docs, read(spark, sf_dir, "labels")).where(~F.col("toxic")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links are of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8."""
    return simhash.one_of_each(docs, groups=near_text.near_duplicates(docs, width=5, similarity=0.8))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where it was masked."""
    found = secrets.annotate(docs)
    masked = F.exists("spans", lambda s: s["live"])
    return secrets.mask(found.withColumn("_masked", masked)).withColumn("n_chars", F.when(F.col("_masked"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written as Parquet and read again; common.clean_up drops what its operations left."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        was, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(was)  # at most two copies of the corpus stand at a time
    return docs


#: SQL expresses neither the fitted model nor the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None
