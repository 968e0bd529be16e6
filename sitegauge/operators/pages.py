"""Stored pages to text and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.once import computed_once
from ..functions.rules import LINK_RULES, LinkRule, link_category


def page_texts(pages: DataFrame, min_chars: int | None = 50) -> DataFrame:
    """``page_id, url, text``; pages whose text has at most ``min_chars`` characters are dropped."""
    out = computed_once(pages, ["page_id", "url"], text=H.html_text(F.col("html")))
    return out if min_chars is None else out.filter(F.length("text") > min_chars)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per usable link: ``page_id, url, link_no, href, link_text, target``.

    Links without address and links to files are skipped; ``target`` is absolute.
    """
    found = pages.select("page_id", "url", F.posexplode_outer(H.anchors(F.col("html"))).alias("link_no", "anchor"))
    parts = computed_once(
        found.filter(F.col("anchor").isNotNull()),
        ["page_id", "url", "link_no"],
        href=H.anchor_href(F.col("anchor")),
        link_text=H.anchor_text(F.col("anchor")),
    )
    links = parts.filter((F.col("href") != "") & ~U.is_file_link(F.col("href")))
    keep = ["page_id", "url", "link_no", "href", "link_text"]
    return computed_once(links, keep, target=U.resolve_url(F.col("url"), F.col("href")))


def same_domain(links: DataFrame, domain: str = "allowed_domain") -> DataFrame:
    """Keep links whose host part contains the allowed domain; an empty domain admits all."""
    return links.filter(F.contains(U.url_netloc(F.col("target")), F.col(domain)))


def categorise_links(links: DataFrame, rules: tuple[LinkRule, ...] = LINK_RULES) -> DataFrame:
    """Add ``category`` and keep links that fall into one."""
    category = link_category(F.col("target"), F.col("link_text"), rules)
    return computed_once(links, links.columns, category=category).filter(F.col("category").isNotNull())


def startup_links(
    list_pages: DataFrame, base_url: str, prefix: str = "/startups/", limit: int | None = None, ending: str = ".html"
) -> DataFrame:
    """Detail-page addresses of list pages, ``detail_url`` and where each first occurs, ``at`` (page_id, link_no).

    With ``limit`` the first ones by that place, which sorts as a top-k without moving the others.
    """
    anchors = list_pages.select(
        "page_id", F.posexplode(H.anchors(F.col("html"))).alias("link_no", "anchor")
    ).select("page_id", "link_no", H.anchor_href(F.col("anchor")).alias("href"))
    wanted = anchors.filter(F.col("href").startswith(prefix) & F.col("href").endswith(ending))
    once = wanted.groupBy("href").agg(F.min(F.struct("page_id", "link_no")).alias("_at"))
    chosen = once if limit is None else once.orderBy("_at").limit(limit)
    return chosen.select(F.concat(F.lit(base_url), F.col("href")).alias("detail_url"), F.col("_at").alias("at"))


def startup_details(
    detail_pages: DataFrame,
    title_suffix: str = "｜J-Startup",
    css_class: str = "btm-arrow-blank",
    tag: str = "div",
    label: str = "D",
) -> DataFrame:
    """``company_name, url, revenue_class`` from detail pages that give both name and address."""
    html = F.col("html")
    name = F.trim(F.replace(H.page_title(html), F.lit(title_suffix), F.lit("")))
    parts = computed_once(detail_pages, ["page_id"], company_name=name, url=H.first_link_in(html, css_class, tag))
    named = parts.filter((F.col("company_name") != "") & (F.col("url") != ""))
    return named.withColumn("revenue_class", F.lit(label))
