"""Embedding, pooling, padding and page-to-company scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.rules import CATEGORY_IDS, REVENUE_CLASSES, REVENUE_IDS, decode_label, range_label
from ..functions.text import is_blank
from .corpus import CHUNK_CHARS, chunk_records
from .ranking import first_k

PASSAGE = "passage: "


# ------------------------------------------------------------------ embedding
def hashing_encoder(size: int) -> Callable[[], Callable]:
    """Deterministic stand-in encoder: words hashed into ``size`` buckets, unit length.

    Has the shape ``predict_batch_udf`` asks for, like a real model's factory.
    """

    def make_predict_fn():
        import hashlib
        import re
        from functools import lru_cache
        from itertools import chain

        import numpy as np

        @lru_cache(maxsize=1 << 16)
        def bucket(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % size

        word = re.compile(r"[^\W]{2,}")

        def predict(texts):
            found = [word.findall(t.lower()) for t in texts]
            rows = np.repeat(np.arange(len(texts)), [len(words) for words in found])
            places = np.fromiter(map(bucket, chain.from_iterable(found)), dtype=np.int64, count=len(rows))
            out = np.bincount(rows * size + places, minlength=len(texts) * size).reshape(len(texts), size).astype(np.float64)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms > 0, norms, 1.0)

        return predict

    return make_predict_fn


def embed(rows: DataFrame, text: str, make_predict_fn: Callable, size: int, batch_size: int = 256, out: str = "vector") -> DataFrame:
    """Unit vectors of ``"passage: " + text`` from a user's encoder, in Arrow batches."""
    encode = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    return rows.withColumn(out, encode(F.concat(F.lit(PASSAGE), F.col(text))))


def mean_vector(vector: Column) -> Column:
    """Aggregate: element-wise mean; partial results are combined before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return rows.groupBy(*keys).agg(mean_vector(F.col(vector)).alias(vector))


def category_vectors(
    rows: DataFrame, company: str, category: str, vector: str, categories: tuple[str, ...], size: int
) -> DataFrame:
    """Mean vector per company and category, one column ``{category}_vec`` each, zeros if absent.

    One aggregate over (company, category), then a pivot with the category list given.
    """
    pooled = mean_pool(rows, [company, category], vector)
    wide = pooled.groupBy(company).agg(
        *[
            F.coalesce(F.any_value(F.when(F.col(category) == c, F.col(vector)), True), A.zeros(size)).alias(f"{c}_vec")
            for c in categories
        ]
    )
    return wide


def assembled(rows: DataFrame, parts: list[Column], out: str) -> DataFrame:
    """Blocks of features in the given order as one array."""
    return rows.withColumn(out, F.concat(*[A.doubles(p) for p in parts]))


def embed_records(
    records: DataFrame, company: str, category: str, text: str, make_predict_fn: Callable, size: int
) -> DataFrame:
    """Chunks of every record, encoded and averaged per company and category."""
    chunks = chunk_records(records, text, [company, category], CHUNK_CHARS, min_chars=1)
    vectors = embed(chunks, "chunk", make_predict_fn, size).select(company, category, "vector")
    return mean_pool(vectors, [company, category], "vector")


# ------------------------------------------------------------------ attention pooling
def attention_logit(vector: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """``w2 · tanh(W1 v + b1) + b2`` as a native expression."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in w1])
    biases = F.array(*[F.lit(float(b)) for b in b1])
    hidden = F.zip_with(F.transform(rows, lambda r: A.dot(r, vector)), biases, lambda h, b: F.tanh(h + b))
    return A.dot(hidden, F.array(*[F.lit(float(x)) for x in w2])) + F.lit(float(b2))


def attention_pool(
    chunks: DataFrame, keys: list[str], order: str, vector: str, logit: Column, max_chunks: int = 15
) -> DataFrame:
    """Soft-max weighted mean of the first ``max_chunks`` chunk vectors of each page.

    The chunk limit belongs to the model, so a page is a small group: its chunks are gathered
    once and the rest is array arithmetic. Padding is simply absent.
    """
    scored = chunks.select(*keys, order, A.doubles(F.col(vector)).alias("_v"), logit.alias("_w"))
    kept = first_k(scored, keys, [order], max_chunks)
    page = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_w").alias("w"), F.col("_v").alias("v")))).alias("c")
    )
    probs = page.withColumn("p", A.softmax(F.transform("c", lambda x: x["w"])))
    weighted = F.zip_with("c", "p", lambda c, p: F.transform(c["v"], lambda x: x * p))
    pooled = F.aggregate(
        F.slice(weighted, 2, max_chunks), F.get(weighted, 0), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    return probs.select(*keys, F.size("c").alias("n_chunks"), pooled.alias(vector))


def padded_pages(
    chunks: DataFrame, keys: list[str], order: str, tokens: str, max_chunks: int, max_tokens: int
) -> DataFrame:
    """Token ids and masks of a page in model shape: ``max_chunks`` rows of ``max_tokens``."""
    kept = first_k(chunks.select(*keys, order, tokens), keys, [order], max_chunks)
    page = kept.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t")))), lambda x: x["t"]
        ).alias("ids")
    )
    no_tokens = F.array_repeat(F.lit(0), max_tokens)
    ids = F.transform("ids", lambda t: A.pad_to(t, max_tokens, 0))
    masks = F.transform("ids", lambda t: A.pad_mask(t, max_tokens))
    missing = F.lit(max_chunks) - F.size("ids")
    return page.select(
        *keys,
        F.concat(ids, F.array_repeat(no_tokens, missing)).alias("input_ids"),
        F.concat(masks, F.array_repeat(no_tokens, missing)).alias("attention_mask"),
        A.pad_mask(F.col("ids"), max_chunks).alias("chunk_mask"),
    )


# ------------------------------------------------------------------ fusion classifier
def seeded_weights(vector_size: int, n_categories: int, n_classes: int, embed_size: int = 64, hidden: int = 256, seed: int = 42) -> dict:
    """Random weights in the model's shapes, for tests and benches."""
    import numpy as np

    r = np.random.default_rng(seed)
    return {
        "text_w": r.normal(0, vector_size**-0.5, (hidden, vector_size)),
        "text_b": r.normal(0, 0.01, hidden),
        "cat_e": r.normal(0, 1, (n_categories, embed_size)),
        "cat_w": r.normal(0, embed_size**-0.5, (hidden, embed_size)),
        "cat_b": r.normal(0, 0.01, hidden),
        "out_w": r.normal(0, (2 * hidden) ** -0.5, (n_classes, 2 * hidden)),
        "out_b": r.normal(0, 0.01, n_classes),
    }


def fusion_classifier(weights: dict) -> Callable[[], Callable]:
    """Text and category projected by ReLU layers, concatenated, linear, soft-max."""

    def make_predict_fn():
        import numpy as np

        w = weights
        category = np.maximum(w["cat_e"] @ w["cat_w"].T + w["cat_b"], 0.0)

        def predict(vectors, category_ids):
            text = np.maximum(vectors @ w["text_w"].T + w["text_b"], 0.0)
            fused = np.hstack([text, category[category_ids.astype(int).ravel()]])
            logits = fused @ w["out_w"].T + w["out_b"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make_predict_fn


def score_pages(pages: DataFrame, vector: str, category_id: str, weights: dict, out: str = "probs", batch_size: int = 1024) -> DataFrame:
    """Class probabilities per page, in Arrow batches."""
    size = weights["text_w"].shape[1]
    predict = predict_batch_udf(
        fusion_classifier(weights),
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[size], None],
    )
    return pages.withColumn(out, predict(A.doubles(F.col(vector)), F.col(category_id)))


# ------------------------------------------------------------------ page to company
def usable_pages(pages: DataFrame, text: str, category: str, ids: dict[str, int] = CATEGORY_IDS) -> DataFrame:
    """Pages with text and a known category."""
    return pages.filter(~is_blank(F.col(text)) & F.col(category).isin(*ids))


def mean_probabilities(pages: DataFrame, company: str, probs: str, n_classes: int) -> DataFrame:
    """Mean probability vector per company: one average per class, combined before the shuffle."""
    means = F.array(*[F.avg(F.get(F.col(probs), F.lit(i))) for i in range(n_classes)])
    return pages.groupBy(company).agg(F.count(F.lit(1)).alias("n_pages"), means.alias(probs))


def company_scores(
    pages: DataFrame,
    company: str,
    probs: str,
    ids: dict[str, int] = REVENUE_IDS,
    companies: DataFrame | None = None,
) -> DataFrame:
    """Class, range, confidence and class probabilities per company.

    With ``companies`` given, those without a usable page get the status ``no_text``.
    """
    scored = mean_probabilities(pages, company, probs, len(ids))
    order = [c for c in REVENUE_CLASSES if c in ids] + sorted(set(ids) - set(REVENUE_CLASSES))
    label = decode_label(A.argmax(F.col(probs)), ids)
    shown = F.map_from_arrays(
        F.array(*[F.lit(c) for c in order]),
        F.array(*[F.round(F.get(F.col(probs), F.lit(ids[c])), 4) for c in order]),
    )
    if companies is not None:
        scored = companies.select(company).distinct().join(scored, company, "left")
    has = F.col("n_pages").isNotNull()
    return scored.select(
        company,
        F.when(has, label).alias("estimated_class"),
        F.when(has, range_label(label)).alias("estimated_range"),
        F.round(F.array_max(probs), 4).alias("confidence"),
        F.when(has, shown).alias("class_probabilities"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.when(has, F.lit("ok")).otherwise(F.lit("no_text")).alias("status"),
    )
