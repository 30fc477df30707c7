"""Corpus pipeline: quality rules, near-duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet in the shared folder and gives what it reads back
to the next stage.  All stages but the last return the columns of documents.

Defined cases: a null text counts as empty, so the quality rules reject it (fewer than
ten words); rows without doc_id go through all stages like others, and keep a null
doc_id; of repeated rows, as of all exact and near copies, one stays, that of the
smallest doc_id (of equal ids with equal texts any, they are alike; an id with several
texts keeps each that no other document resembles); a document is taken as often as the
mix takes it, so the last stage has a row per copy; ties in the mix go by hash and
doc_id; texts are read whole, whatever their length; an empty table passes through as
an empty one; further columns, of whatever name, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcomelens.llm import bpe, minhash, mixing, quality, secret_scan
from outcomelens.llm.common import read, written
from outcomelens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy accepts."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id."""
    return minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: a row per copy taken, in training order."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and a hash of their decoded text."""
    path = vocabulary()
    return (docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), path).alias("token_ids"))
            .select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                    F.sha2(bpe.decode(F.col("token_ids"), path), 256).alias("decoded_sha256")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("tokens", tokens),
]
#: The near-duplicate and token stages can't be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
