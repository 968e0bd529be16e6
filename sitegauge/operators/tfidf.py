"""TF-IDF with smooth idf, document-frequency limits and a bounded vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_CHARS

TOKEN = rf"(?s)[{WORD_CHARS}]{{2,}}"
MAX_FEATURES = 500
MIN_DF = 3
MAX_DF = 0.90
BROADCAST_TERMS = 100_000


def regex_tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def tokenizer_udf(make_tokenizer: Callable[[], Callable[[str], list[str]]], window: int = 5_000):
    """Arrow UDF around a user's tokenizer, built once per Python worker.

    Texts are lower-cased and handed over in windows of ``window`` characters.
    """

    def tokenize(batches):
        split = make_tokenizer()
        for texts in batches:
            yield texts.map(
                lambda t: [w for i in range(0, len(t or ""), window) for w in split(t.lower()[i : i + window])]
            )

    tokenize.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(tokenize, T.ArrayType(T.StringType()))


def term_counts(docs: DataFrame, key: str, text: str, tokens: Column | None = None) -> DataFrame:
    """``key, term, tf`` for all texts of a key; counts are combined before the shuffle."""
    words = regex_tokens(F.coalesce(F.col(text), F.lit(""))) if tokens is None else tokens
    rows = docs.select(key, F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull())
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Vocabulary:
    """Chosen terms (``term, term_no, df, total, idf``), at most ``most`` rows where that is known."""

    terms: DataFrame
    most: int | None = None


def fit_vocabulary(
    counts: DataFrame,
    n_docs: DataFrame,
    key: str,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> Vocabulary:
    """Most frequent terms within the document-frequency limits; ties break by term.

    ``n_docs`` is a one-cell frame with the number of documents, used as a scalar subquery.
    Terms are numbered alphabetically.
    """
    n = n_docs.scalar()
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    within = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    top = within.orderBy(F.col("total").desc(), "term").limit(max_features)
    # At most ``max_features`` rows from here on: one array numbers them.
    packed = top.agg(F.sort_array(F.collect_list(F.struct("term", "df", "total"))).alias("all"))
    terms = packed.select(F.posexplode("all").alias("term_no", "t")).select(
        F.col("t.term").alias("term"),
        "term_no",
        F.col("t.df").alias("df"),
        F.col("t.total").alias("total"),
        (F.log((1 + n) / (1 + F.col("t.df"))) + 1).alias("idf"),
    )
    return Vocabulary(terms, max_features)


def save_vocabulary(vocabulary: Vocabulary, path: str) -> None:
    vocabulary.terms.write.mode("overwrite").parquet(path)


def load_vocabulary(spark, path: str) -> Vocabulary:
    schema = "term string, term_no int, df long, total long, idf double"
    return Vocabulary(spark.read.schema(schema).parquet(path))


def tfidf_weights(counts: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """Long form ``key, term, term_no, weight``, every key's weights of unit length.

    A vocabulary bounded by at most ``BROADCAST_TERMS`` rows is broadcast; for others their size
    decides. A key has no more terms than the vocabulary, so the norm needs only small groups.
    """
    terms = vocabulary.terms.select("term", "term_no", "idf")
    if vocabulary.most is not None and vocabulary.most <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    weighted = counts.join(terms, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    entries = F.sort_array(F.collect_list(F.struct("term_no", "term", "_w")))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")))
    grouped = weighted.groupBy(key).agg(entries.alias("_all"), norm.alias("_norm"))
    return grouped.select(key, "_norm", F.explode("_all").alias("_one")).select(
        key,
        F.col("_one.term").alias("term"),
        F.col("_one.term_no").alias("term_no"),
        (F.col("_one._w") / F.col("_norm")).alias("weight"),
    )


def tfidf_vectors(weights: DataFrame, key: str, size: int) -> DataFrame:
    """Dense array per key in vocabulary order; absent terms are 0."""
    pairs = F.map_from_entries(F.collect_list(F.struct("term_no", "weight")))
    grouped = weights.groupBy(key).agg(pairs.alias("_m"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0))
    )
    return grouped.select(key, dense.alias("tfidf"))
