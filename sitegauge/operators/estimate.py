"""From stored pages to a company's estimate: budget, chunks, vectors, attention, classifier, mean, summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once
from ..functions.rules import CATEGORY_IDS, REVENUE_IDS
from . import crawl
from .companies import encode_with
from .corpus import CHUNK_CHARS, chunk_records
from .vectors import attention_pool, company_scores, embed, score_pages, usable_pages

SCORED_CHUNKS = 8


@dataclass(frozen=True)
class Estimator:
    """An encoder's factory and vector size, the attention's logit over a vector column, and the classifier's weights."""

    encoder: Callable[[], Callable]
    size: int
    logit: Callable[[Column], Column]
    weights: dict


def company_estimates(
    pages: DataFrame,
    company: str,
    category: str,
    order: list[str],
    text: str,
    model: Estimator,
    ids: dict[str, int] = REVENUE_IDS,
    category_ids: dict[str, int] = CATEGORY_IDS,
    budget: int = crawl.BUDGET_CHARS,
    max_chunks: int = SCORED_CHUNKS,
) -> DataFrame:
    """``vectors.company_scores`` for every company of ``pages``, with ``features_summary`` of its crawl.

    A category's text gathers pages up to ``budget``; its first ``max_chunks`` chunks (the last one
    of any length) are encoded and pooled by attention, and scored with the category's id. Texts
    without a known category count in the summary only. Pages' texts are worked out once and
    written, cut to what can count. A company without usable text has the status ``no_text``.
    """
    stored = crawl.stored_texts(pages, [company, category], order, text, budget)
    texts = crawl.budget_texts(stored, [company, category], order, text, budget)
    gathered = usable_pages(texts, "text", category, category_ids)
    chunks = chunk_records(gathered, "text", [company, category], CHUNK_CHARS, min_chars=1)
    # A category's text is one record, so its chunk number tells which chunks count.
    chunks = chunks.filter(F.col("chunk_no") < max_chunks)
    vectors = embed(chunks, "chunk", model.encoder, model.size).select(company, category, "chunk_no", "vector")
    pooled = attention_pool(vectors, [company, category], "chunk_no", "vector", model.logit(F.col("vector")), max_chunks)
    # The classifier is given plain columns: it can't be handed expressions over arrays.
    ready = computed_once(pooled, [company], vector=F.col("vector"), _category_id=encode_with(F.col(category), category_ids))
    scored = score_pages(ready, "vector", "_category_id", model.weights)
    summary = crawl.summary_of(stored, texts, company, category)
    shown = F.struct("pages_crawled", "found_categories", "text_length_total").alias("features_summary")
    estimates = company_scores(scored, company, "probs", ids, companies=summary.select(company))
    return estimates.join(summary.select(company, shown), company)
