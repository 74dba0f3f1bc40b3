"""The corpus pipeline: raw documents to encoded, deduplicated, clean text.

Every stage is one operator on all that its predecessor kept, written as Parquet
and read again before the next. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkrecall.llm import bpe, decontaminate, exact_dedup, langid, simhash
from sparkrecall.llm.common import delete_path, release, shared_dir, table, written
from sparkrecall.llm.queries import tokenizer_path
from sparkrecall.packaging import ensure_shipped


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages go."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    return bpe.encode_texts(docs, tokenizer_path(), output="ids")


def _shipped(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_shipped(spark)
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    ("language ID", _shipped(language_id)),
    ("exact dedup", _shipped(exact)),
    ("SimHash near-dedup", _shipped(near)),
    ("benchmark decontamination", _shipped(benchmark_free)),
    ("BPE encoding and decoding", _shipped(encode)),
]

#: Language profiles and BPE are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written besides its result,
    and the result before it, is deleted once its own result stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path, mark = f"{folder}/{k}", written()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)
        if k:
            delete_path(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
