"""Crawl semantics over stored pages: text budget per category, summary, link frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, url_netloc
from ..session import cut_lineage
from .ranking import first_k

BUDGET_CHARS = 5_000
MIN_PAGE_CHARS = 50
MAX_DEPTH = 3


def budget_texts(
    pages: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    budget: int = BUDGET_CHARS,
    min_chars: int = MIN_PAGE_CHARS,
) -> DataFrame:
    """Text gathered per group: while it is below ``budget``, the next page adds a space and
    its first ``budget`` characters. Pages of at most ``min_chars`` characters add nothing.

    Every page adds at least ``min_chars + 2`` characters, so only the first
    ``ceil(budget / (min_chars + 2))`` pages can matter; that bound keeps the ordered fold small
    without changing its result.
    """
    usable = pages.filter(F.length(text) > min_chars).select(
        *keys, *order, F.substring(F.col(text), 1, budget).alias("_text")
    )
    most = -(-budget // (min_chars + 2))
    kept = first_k(usable, keys, order, most)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "_text")))
    gathered = F.aggregate(
        ordered,
        F.lit(""),
        lambda acc, p: F.when(F.length(acc) < budget, F.concat(acc, F.lit(" "), p["_text"])).otherwise(acc),
    )
    return kept.groupBy(*keys).agg(gathered.alias("text"))


def crawl_summary(
    pages: DataFrame,
    company: str,
    category: str,
    order: list[str],
    text: str,
    budget: int = BUDGET_CHARS,
    min_chars: int = MIN_PAGE_CHARS,
) -> DataFrame:
    """Pages seen, categories with text and total gathered length per company.

    Of a page at most ``budget`` characters can count; those are written once, so that texts are
    extracted once for both the pages seen and the texts gathered.
    """
    stored = stored_texts(pages, [company, category], order, text, budget)
    texts = budget_texts(stored, [company, category], order, text, budget, min_chars)
    return summary_of(stored, texts, company, category)


def stored_texts(pages: DataFrame, keys: list[str], order: list[str], text: str, budget: int = BUDGET_CHARS) -> DataFrame:
    """The columns that gathering needs, written once below the shared folder; texts cut to what can count."""
    return cut_lineage(pages.select(*keys, *order, F.substring(F.col(text), 1, budget).alias(text)), "page-texts")


def summary_of(pages: DataFrame, texts: DataFrame, company: str, category: str) -> DataFrame:
    """``crawl_summary`` from all pages and the texts gathered of them."""
    seen = pages.groupBy(company).agg(F.count(F.lit(1)).alias("pages_crawled"))
    found = texts.groupBy(company).agg(
        F.sort_array(F.collect_set(category)).alias("found_categories"),
        F.sum(F.length("text")).alias("text_length_total"),
    )
    return seen.join(found, company, "left").select(
        company,
        "pages_crawled",
        F.coalesce("found_categories", F.array().cast("array<string>")).alias("found_categories"),
        F.coalesce("text_length_total", F.lit(0)).alias("text_length_total"),
    )


def crawl_results(
    pages: DataFrame,
    company: str,
    category: str,
    order: list[str],
    text: str,
    budget: int = BUDGET_CHARS,
    min_chars: int = MIN_PAGE_CHARS,
) -> DataFrame:
    """``company, texts map<category, text>``; a company has a handful of categories."""
    texts = budget_texts(pages, [company, category], order, text, budget, min_chars)
    entries = F.sort_array(F.collect_list(F.struct(F.col(category), F.col("text"))))
    return texts.groupBy(company).agg(F.map_from_entries(entries).alias("texts"))


def expand_frontier(
    seeds: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    max_depth: int = MAX_DEPTH,
    budget: int = BUDGET_CHARS,
    min_chars: int = MIN_PAGE_CHARS,
    any_domain: bool = False,
) -> DataFrame:
    """Stored pages reached from each company's start page: ``company, url, category, depth``.

    ``seeds``: company, url. ``links``: src, link_no, target, category. ``pages``: url, chars.
    Links of a page are followed when they stay on the start page's domain and their category
    has gathered fewer than ``budget`` characters up to that depth; each address is requested
    once per company, under the category of its first link by (src, link_no). A category is
    full exactly when its page sizes sum up to the budget, so a sum replaces the ordered fold.
    Page sizes, links and each round are written to the checkpoint folder: text and links are
    extracted once, the plan stays short, and lost executors cost nothing already written.
    """
    sizes = pages.select(canonical_url(F.col("url")).alias("url"), "chars")
    page_sizes = cut_lineage(sizes.groupBy("url").agg(F.min("chars").alias("chars")))
    edges = cut_lineage(
        links.select(
            canonical_url(F.col("src")).alias("src"),
            "link_no",
            canonical_url(F.col("target")).alias("target"),
            "category",
        )
    )
    domain = F.lit("") if any_domain else url_netloc(F.col("url"))
    asked = seeds.select(
        "company",
        canonical_url(F.col("url")).alias("url"),
        F.lit("top").alias("category"),
        F.lit(0).alias("depth"),
        domain.alias("domain"),
    )
    asked = cut_lineage(asked)
    reached: DataFrame | None = None
    frontier = asked
    for depth in range(max_depth + 1):
        fetched = frontier.join(page_sizes, "url").select(
            "company", "url", "category", "depth", "domain", "chars"
        )
        fetched = cut_lineage(fetched)
        reached = fetched if reached is None else reached.unionByName(fetched)
        if depth == max_depth:
            break
        gain = F.when(F.col("chars") > min_chars, 1 + F.least("chars", F.lit(budget))).otherwise(F.lit(0))
        full = (
            reached.groupBy("company", "category")
            .agg(F.sum(gain).alias("gathered"))
            .filter(F.col("gathered") >= budget)
            .select("company", "category")
        )
        found = (
            fetched.select("company", F.col("url").alias("src"), "domain")
            .join(edges, "src")
            .filter(F.contains(url_netloc(F.col("target")), F.col("domain")))
            .join(full, ["company", "category"], "left_anti")
            .groupBy("company", F.col("target").alias("url"))
            .agg(F.min(F.struct("src", "link_no", "category", "domain")).alias("_via"))
        )
        frontier = cut_lineage(
            found.join(asked.select("company", "url"), ["company", "url"], "left_anti").select(
                "company",
                "url",
                F.col("_via.category").alias("category"),
                F.lit(depth + 1).alias("depth"),
                F.col("_via.domain").alias("domain"),
            )
        )
        asked = asked.unionByName(frontier)
    return reached.select("company", "url", "category", "depth")
