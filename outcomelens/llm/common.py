"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcomelens.operators.ordering import written  # noqa: F401  (shared with the operators)
from outcomelens.session import ensure_checkpoint_dir

#: What the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket(key, modulus: int):
    """crc32 of the key's decimal text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python tasks that run in the meantime get so many rows at a time, which bounds what whole texts take in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def open_store(uri: str):
    """The file system of a shared folder, and the folder's path there, for use in a task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def spread(rows: DataFrame, table: DataFrame, key: str = "t", by: str = "doc_id", how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` with a table of one row per ``key``, through (key, salt).

    The salt comes from the column ``by``, so the rows of a frequent key are dealt over tasks.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    back = rows.select(key, "salt").distinct().join(table, key)
    return rows.join(back, [key, "salt"], how).drop("salt")
