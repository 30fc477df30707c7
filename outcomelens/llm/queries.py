"""The numbered queries over the driver's tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outcomelens.llm import alignment, ann, bpe, impact, langid, lm, minhash, mixing, oracle, pu_quality, quality, secret_scan, warc, whitening
from outcomelens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return deco


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_warc", oracle.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(read(spark, sf_dir, "pages"))


@query("op3_minhash_dedup")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(read(spark, sf_dir, "documents"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"), vocabulary())


@query("op5_secret_scan", oracle.SECRET_SCAN)
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))


@query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(read(spark, sf_dir, "documents"))


@query("op7_mixing", oracle.MIXING)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


@query("op9_quality_rules", oracle.QUALITY)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"))


@query("op10_pu_quality")
def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(read(spark, sf_dir, "embeddings"))


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(read(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(read(spark, sf_dir, "embeddings"))


@query("op11_exact_topk", oracle.EXACT_TOPK)
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.digest(read(spark, sf_dir, "embeddings"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
