"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import jaccard, packing, quality, secret_scan, toxicity
from cadenza.llm.common import shared_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, in pieces, and their places in sequences of 4096."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_rules),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: No SQL for a trained classifier and a library's ids; the tests have a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{k}-{name}")
    return docs
