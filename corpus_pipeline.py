"""A corpus from raw documents to token ids: five stages, each written as a table before the next reads it.

1. quality classifier: documents whose probability of the best grade is under one half go (bad text, toxic text);
2. exact dedup: of equal texts the row with the largest doc_id stays;
3. near dedup: of each SimHash component the row with the smallest doc_id stays;
4. benchmark decontamination: documents with a window of a benchmark item go;
5. byte-pair encoding: the ids of what is left, with digests of ids and decoded text.

The first four return the columns of ``documents``; a null text counts as empty throughout, and no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import bpe, exact, ordinal, simhash, suffixes
from sitegauge.llm.common import materialised, table
from sitegauge.llm.queries import LEAST_TAIL, graded, grades


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = graded(docs, grades(spark, sf_dir))
    return scored.where(ordinal.accepted(scored, LEAST_TAIL)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, distance=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        "n_tokens",
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", tokens),
]

# The fitted classifier and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
