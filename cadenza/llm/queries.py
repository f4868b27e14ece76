"""The registered query of each operator, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, hnsw, id_store, jaccard, packing, quality, secret_scan, token_counts, toxicity, warc_zip
from .common import shared_dir, written
from .oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_dir(spark, "ids")
    id_store.write(_table(spark, sf_dir, "documents"), store, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return id_store.summaries(spark, store)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    packages = written(warc_zip.write(_table(spark, sf_dir, "pages"), f"{folder}/packages"), f"{folder}/list")
    # A task for every few packages, however small their list is.
    return warc_zip.read(packages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), f"{folder}/packages")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_quality_rules, op4_toxicity, op5_id_store, op6_byte_bpe, op7_hnsw, op8_warc_zip, op9_token_counts, op10_best_fit)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
