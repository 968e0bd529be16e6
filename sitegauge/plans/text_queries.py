"""Pages, links, chunks, ordered grouping, budget and rule-based features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.rules import (
    COUNT_RULES,
    NUMBER_RULES,
    UNIQUE_RULES,
    CountRule,
    LinkRule,
    NumberRule,
    UniqueRule,
)
from ..functions.text import SPACE_CHARS, WORD_CHARS
from ..functions.urls import url_netloc
from ..operators import corpus, crawl, features, pages
from .registry import query, table

# Page text in SQL: the same steps, with the character references the fixture contains.
PAGE_TEXT_SQL = rf"""
page_text AS (
  SELECT page_id, url, trim(regexp_replace(
    replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '{H.HIDDEN}', ' ', 'g'), '<[/!?a-zA-Z][^>]*>', ' ', 'g'),
      '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'),
    '[{SPACE_CHARS}]+', ' ', 'g')) AS text
  FROM pages)
"""
HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
SECTION = "regexp_extract(url, '://[^/]*/([a-z]+)', 1)"


def _host():
    return url_netloc(F.col("url"))


def _section():
    return F.regexp_extract("url", "://[^/]*/([a-z]+)", 1)


@query(
    "html_to_text",
    f"WITH {PAGE_TEXT_SQL} SELECT page_id, text, length(text) AS chars FROM page_text",
)
def html_to_text(spark, sf_dir):
    texts = pages.page_texts(table(spark, sf_dir, "pages"), min_chars=None)
    return texts.select("page_id", "text", F.length("text").cast("long").alias("chars"))


PAGE_SUMMARY_SQL = f"""
WITH {PAGE_TEXT_SQL},
long_pages AS (SELECT page_id, {HOST} AS host, text FROM page_text WHERE length(text) > 50),
chunks AS (
  SELECT page_id, host, substring(text, (i * 400 + 1)::BIGINT, 400) AS chunk
  FROM long_pages, unnest(range(0, (length(text) + 399) // 400)) AS r(i))
SELECT host, count(DISTINCT page_id) AS pages, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars
FROM chunks WHERE length(chunk) >= 50 GROUP BY host
"""


@query("page_text_summary", PAGE_SUMMARY_SQL)
def page_text_summary(spark, sf_dir):
    texts = pages.page_texts(table(spark, sf_dir, "pages")).select("page_id", _host().alias("host"), "text")
    chunks = corpus.chunk_records(texts, "text", ["host", "page_id"])
    per_page = chunks.groupBy("host", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("chars")
    )
    return per_page.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chunks"), F.sum("chars").alias("chars")
    )


LINKS_SQL = rf"""
found AS (
  SELECT page_id, url, unnest(found) AS anchor, unnest(range(len(found))) AS link_no
  FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{H.HIDDEN_FROM_LINKS}', ' ', 'g'),
                                                '{H.ANCHOR}') AS found FROM pages)),
parsed AS (
  SELECT page_id, url, link_no,
         replace(regexp_extract(anchor, 'href="([^"]*)"', 1), '&amp;', '&') AS href,
         lower(trim(replace(regexp_extract(anchor, '>([^<]*)<', 1), '&amp;', '&'))) AS link_text
  FROM found),
links AS (
  SELECT page_id, url, link_no, href, link_text,
         regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS target
  FROM parsed
  WHERE href <> '' AND NOT regexp_matches(lower(href), '\.(pdf|zip|doc|docx|xls|xlsx|png|jpg|jpeg|gif)$'))
"""


@query("link_extract", f"WITH {LINKS_SQL} SELECT page_id, link_no::INT AS link_no, href, link_text, target FROM links")
def link_extract(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "link_no", "href", "link_text", "target")


FIXTURE_LINK_RULES = (
    LinkRule("about", "/the|/an", "über|pour"),
    LinkRule("business", "/de|/le", "que$"),
    LinkRule("sustainability", "ción", "ó"),
    LinkRule("ir", "/e", "^i"),
    LinkRule("recruit", "tion", "ment"),
    LinkRule("history", "sch", "ä"),
    LinkRule("news", "/s", "[.,]$"),
)


def _cascade_sql(rules: tuple[LinkRule, ...]) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(lower(target), '{r.url}') OR regexp_matches(link_text, '{r.text}') THEN '{r.category}'"
        for r in rules
    )
    return f"CASE {arms} END"


@query(
    "link_categorise",
    f"""WITH {LINKS_SQL}, labelled AS (
          SELECT *, {_cascade_sql(FIXTURE_LINK_RULES)} AS category FROM links)
        SELECT page_id, link_no::INT AS link_no, target, category FROM labelled WHERE category IS NOT NULL""",
)
def link_categorise(spark, sf_dir):
    links = pages.categorise_links(pages.page_links(table(spark, sf_dir, "pages")), FIXTURE_LINK_RULES)
    return links.select("page_id", "link_no", "target", "category")


@query(
    "link_categorise_default",
    f"""WITH {LINKS_SQL}, labelled AS (
          SELECT *, CASE WHEN regexp_matches(lower(target), 'about|company|profile|corporate|message|philosophy|vision') THEN 'about'
            WHEN regexp_matches(lower(target), 'business|service|solution|product|works|case') THEN 'business'
            WHEN regexp_matches(lower(target), 'sustainability|csr|esg|sdgs|environment')
              OR regexp_matches(link_text, 'sdgs|csr') THEN 'sustainability'
            WHEN regexp_matches(lower(target), 'ir|investor|finance|highlight')
              OR regexp_matches(link_text, 'ir') THEN 'ir'
            WHEN regexp_matches(lower(target), 'recruit|career|jobs') THEN 'recruit'
            WHEN regexp_matches(lower(target), 'history') THEN 'history'
            WHEN regexp_matches(lower(target), 'news|press|release|info|topics') THEN 'news' END AS category
          FROM links)
        SELECT {HOST} AS host, category, count(*) AS links FROM labelled WHERE category IS NOT NULL
        GROUP BY 1, 2""",
)
def link_categorise_default(spark, sf_dir):
    links = pages.categorise_links(pages.page_links(table(spark, sf_dir, "pages")))
    return links.groupBy(_host().alias("host"), "category").agg(F.count(F.lit(1)).alias("links"))


@query(
    "same_domain_links",
    f"""WITH {LINKS_SQL}
        SELECT page_id, link_no::INT AS link_no, target FROM links
        WHERE contains(regexp_extract(target, '://([^/?#]*)', 1), 'example.com')""",
)
def same_domain_links(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages")).withColumn("allowed_domain", F.lit("example.com"))
    return pages.same_domain(links).select("page_id", "link_no", "target")


@query(
    "startup_links",
    f"""WITH {LINKS_SQL}, wanted AS (
          SELECT href, min((page_id, link_no)) AS at FROM parsed
          WHERE starts_with(href, '/t') AND ends_with(href, 'e') GROUP BY href)
        SELECT 'https://example.com' || href AS detail_url FROM wanted""",
)
def startup_links(spark, sf_dir):
    """Every detail link of every list page; the prefix and ending stand in for the site's own."""
    return pages.startup_links(table(spark, sf_dir, "pages"), "https://example.com", "/t", ending="e").select("detail_url")


@query(
    "startup_first_links",
    f"""WITH {LINKS_SQL}, wanted AS (
          SELECT href, min((page_id, link_no)) AS first_at FROM parsed
          WHERE starts_with(href, '/t') AND ends_with(href, 'e') GROUP BY href)
        SELECT 'https://example.com' || href AS detail_url, row_number() OVER (ORDER BY first_at)::INT AS place
        FROM wanted ORDER BY first_at LIMIT 100""",
)
def startup_first_links(spark, sf_dir):
    """The first hundred detail links by where they first occur."""
    first = pages.startup_links(table(spark, sf_dir, "pages"), "https://example.com", "/t", limit=100, ending="e")
    return first.select("detail_url", F.row_number().over(W.orderBy("at")).alias("place"))


@query(
    "html_nested",
    f"""WITH {PAGE_TEXT_SQL} SELECT page_id, trim(text || ' ' || '…≂̸∳ &zzz; ' || page_id) AS text FROM page_text""",
)
def html_nested(spark, sf_dir):
    """Every navigation and footer block holds further ones, and a page ends with named references of HTML5:
    the text is that of the plain page, and the characters they stand for."""
    html = F.col("html")
    for name in ("nav", "footer"):
        inner = f"<{name}>one<aside>two</{name}> three <{name.upper()} class='x'><{name}>four</{name}></{name}></aside>"
        html = F.replace(html, F.lit(f"<{name}>"), F.lit(f"<{name}>{inner}"))
    end = F.concat(F.lit(" &hellip;&NotEqualTilde;&CounterClockwiseContourIntegral; &zzz; </iframe>"), F.col("page_id").cast("string"))
    body = F.regexp_replace(html, r"(?is)</body>.*\z", "")
    texts = pages.page_texts(table(spark, sf_dir, "pages").withColumn("html", F.concat(body, end)), min_chars=None)
    return texts.select("page_id", "text")


@query(
    "startup_details",
    r"""SELECT page_id, trim(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), 'the', '')) AS company_name,
               regexp_extract(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1) AS url, 'D' AS revenue_class
        FROM (SELECT page_id, html FROM pages)
        WHERE trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 'the', '')) <> ''
          AND regexp_extract(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1) <> ''""",
)
def startup_details(spark, sf_dir):
    """Title without a suffix word and the first link of the navigation block of every page."""
    marked = table(spark, sf_dir, "pages").withColumn(
        "html", F.replace("html", F.lit("<nav>"), F.lit('<nav class="btm-arrow-blank">'))
    )
    return pages.startup_details(marked, title_suffix="the", tag="nav")


CHUNKS_SQL = """
chunks AS (
  SELECT doc_id, source, lang, i AS chunk_no, substring(text, (i * 400 + 1)::BIGINT, 400) AS chunk
  FROM documents, unnest(range(0, (length(text) + 399) // 400)) AS r(i))
"""


@query(
    "chunk_text",
    f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_no::INT AS chunk_no, chunk FROM chunks WHERE length(chunk) >= 50",
)
def chunk_text(spark, sf_dir):
    docs = corpus.trainable(table(spark, sf_dir, "documents"), "lang", "text")
    return corpus.chunk_records(docs, "text", ["doc_id"])


@query(
    "chunk_stats",
    f"""WITH {CHUNKS_SQL} SELECT source, lang, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars,
          min(length(chunk)) AS shortest FROM chunks WHERE length(chunk) >= 50 GROUP BY source, lang""",
)
def chunk_stats(spark, sf_dir):
    docs = corpus.trainable(table(spark, sf_dir, "documents"), "lang", "text")
    chunks = corpus.chunk_records(docs, "text", ["source", "lang"])
    size = F.length("chunk").cast("long")
    return chunks.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("chars"), F.min(size).alias("shortest")
    )


@query(
    "ordered_concat",
    """WITH joined AS (SELECT source, lang, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source, lang)
       SELECT source, lang, i AS part_no, substring(t, (i * 20000 + 1)::BIGINT, 20000) AS part_text
       FROM joined, unnest(range(0, (length(t) + 19999) // 20000)) AS r(i)""",
)
def ordered_concat(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.ordered_concat(docs, ["source", "lang"], "doc_id", "text", part_chars=20_000)


@query(
    "ordered_concat_turns",
    """WITH joined AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id, role)
       SELECT conv_id, role, length(t) AS chars, md5(t) AS digest FROM joined""",
)
def ordered_concat_turns(spark, sf_dir):
    """Turn texts per conversation and role; a conversation fits one part."""
    turns = table(spark, sf_dir, "conversations")
    parts = corpus.ordered_concat(turns, ["conv_id", "role"], "turn", "text", part_chars=1 << 24)
    return parts.select(
        "conv_id", "role", F.length("part_text").cast("long").alias("chars"), F.md5("part_text").alias("digest")
    )


@query(
    "company_text",
    """WITH joined AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source)
       SELECT source, i AS part_no, md5(substring(t, (i * 50000 + 1)::BIGINT, 50000)) AS digest
       FROM joined, unnest(range(0, (length(t) + 49999) // 50000)) AS r(i)""",
)
def company_text(spark, sf_dir):
    """All texts of a company in file order."""
    parts = corpus.ordered_concat(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", part_chars=50_000)
    return parts.select("source", "part_no", F.md5("part_text").alias("digest"))


@query(
    "category_order_text",
    """WITH c AS (SELECT source, coalesce(string_agg(text, ' ' ORDER BY doc_id) FILTER (lang = 'fr'), '') AS fr,
                    coalesce(string_agg(text, ' ' ORDER BY doc_id) FILTER (lang = 'en'), '') AS en,
                    coalesce(string_agg(text, ' ' ORDER BY doc_id) FILTER (lang = 'es'), '') AS es FROM documents GROUP BY source),
       joined AS (SELECT source, fr || ' ' || '' || ' ' || en || ' ' || es AS t FROM c)
       SELECT source, i AS part_no, md5(substring(t, (i * 50000 + 1)::BIGINT, 50000)) AS digest
       FROM joined, unnest(range(0, (length(t) + 49999) // 50000)) AS r(i)""",
)
def category_order_text(spark, sf_dir):
    """All texts of a company category by category; one category never occurs."""
    parts = corpus.category_order_concat(
        table(spark, sf_dir, "documents"), "source", "lang", "doc_id", "text", ("fr", "none", "en", "es"), part_chars=50_000
    )
    return parts.select("source", "part_no", F.md5("part_text").alias("digest"))


@query(
    "first_row_attrs",
    """SELECT source, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars
       FROM documents GROUP BY source""",
)
def first_row_attrs(spark, sf_dir):
    return corpus.first_row_attributes(table(spark, sf_dir, "documents"), "source", "doc_id", ["lang", "n_chars"])


def _first_chunks_sql(limit: int, least: int) -> str:
    return f"""WITH {CHUNKS_SQL}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, chunk_no) AS rn
          FROM chunks WHERE length(chunk) >= {least})
        SELECT source, lang, count(*) AS n_chunks, md5(string_agg(chunk, '|' ORDER BY rn)) AS digest
        FROM ranked WHERE rn <= {limit} GROUP BY source, lang"""


def _first_chunks(spark, sf_dir, limit, least):
    docs = table(spark, sf_dir, "documents")
    lists = corpus.page_chunk_lists(docs, ["source", "lang"], "doc_id", "text", limit, min_chars=least)
    return lists.select(
        "source",
        "lang",
        F.size("chunks").cast("long").alias("n_chunks"),
        F.md5(F.array_join("chunks", "|")).alias("digest"),
    )


@query("first_k_chunks", _first_chunks_sql(15, 50))
def first_k_chunks(spark, sf_dir):
    return _first_chunks(spark, sf_dir, 15, 50)


@query("first_k_chunks_scoring", _first_chunks_sql(8, 1))
def first_k_chunks_scoring(spark, sf_dir):
    return _first_chunks(spark, sf_dir, 8, 1)


BUDGET_SQL = """
usable AS (SELECT source, lang, doc_id, substring(text, 1, 5000) AS t FROM documents WHERE length(text) > 50),
budgeted AS (
  SELECT source, lang, list_reduce(list_prepend('', list(t ORDER BY doc_id)),
           lambda acc, x: CASE WHEN length(acc) < 5000 THEN acc || ' ' || x ELSE acc END) AS text
  FROM usable GROUP BY source, lang)
"""


@query("budget_accumulate", f"WITH {BUDGET_SQL} SELECT source, lang, text FROM budgeted")
def budget_accumulate(spark, sf_dir):
    return crawl.budget_texts(table(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"], "text")


@query(
    "crawl_summary",
    f"""WITH {PAGE_TEXT_SQL},
        p AS (SELECT page_id, {HOST} AS host, {SECTION} AS section, text FROM page_text),
        seen AS (SELECT host, count(*) AS pages_crawled FROM p GROUP BY host),
        budgeted AS (
          SELECT host, section, list_reduce(list_prepend('', list(substring(text, 1, 5000) ORDER BY page_id)),
            lambda acc, x: CASE WHEN length(acc) < 5000 THEN acc || ' ' || x ELSE acc END) AS text
          FROM p WHERE length(text) > 50 GROUP BY host, section),
        found AS (SELECT host, string_agg(section, ',' ORDER BY section) AS found_categories,
                         sum(length(text))::BIGINT AS text_length_total FROM budgeted GROUP BY host)
        SELECT host, pages_crawled, coalesce(found_categories, '') AS found_categories,
               coalesce(text_length_total, 0) AS text_length_total
        FROM seen LEFT JOIN found USING (host)""",
)
def crawl_summary(spark, sf_dir):
    texts = pages.page_texts(table(spark, sf_dir, "pages"), min_chars=None)
    routed = texts.select("page_id", _host().alias("host"), _section().alias("section"), "text")
    out = crawl.crawl_summary(routed, "host", "section", ["page_id"], "text")
    return out.withColumn("found_categories", F.array_join("found_categories", ","))


@query(
    "map_unpivot",
    f"""WITH {BUDGET_SQL} SELECT source, lang AS page_category, trim(text) AS text_content FROM budgeted
        WHERE trim(text) <> ''""",
)
def map_unpivot(spark, sf_dir):
    crawls = crawl.crawl_results(table(spark, sf_dir, "documents"), "source", "lang", ["doc_id"], "text")
    return corpus.unpivot_texts(crawls, ["source"])


# Rules that fire on the fixture's invented prose; the real ones need Japanese text and are
# exercised by the tests.
_GAP = f"[{SPACE_CHARS}{WORD_CHARS}]"
FIXTURE_CATEGORIES = ("fr", "en", "de")
FIXTURE_COUNTS = (
    CountRule("article_score", "the|der|die|das|le|la"),
    CountRule("ending_score", r"tion\.|ment|heit|lich"),
    CountRule("digit_score", "[0-9]+"),
)
FIXTURE_UNIQUES = (
    UniqueRule("num_tion_types", "[a-zé]{2,6}tion"),
    UniqueRule("num_er_types", "[a-zß]{2,5}er"),
)
FIXTURE_NUMBERS = (
    NumberRule("line_number", "(?:en|ou)tion", r"[^\n]", None, r"[0-9\.]+", ""),
    NumberRule("near_number", "(?:er|the)(?:st)?", _GAP, 10, "[0-9,]+", ""),
    NumberRule("year_like", "(?:is|un|der)", r"[^\n]", None, "[0-9]{2}", "", default=None),
)


def _features_sql(categories, counts, uniques, numbers, source: str) -> str:
    """The features computed the direct way, on the joined text of each company."""
    cols = []
    for c in categories:
        cols += [
            f"CASE WHEN length({c}) > 0 THEN 1 ELSE 0 END AS has_{c}",
            f"round(ln(1 + length({c})), 6) AS {c}_length_log",
            f"round(length({c}) / (length(t) + 1), 6) AS {c}_ratio",
        ]
    cols += [f"round(ln(1 + len(regexp_extract_all(t, '{r.pattern}'))), 6) AS {r.feature}" for r in counts]
    cols += [f"len(list_distinct(regexp_extract_all(t, '{r.pattern}')))::INT AS {r.feature}" for r in uniques]
    for r in numbers:
        reach = "*" if r.max_gap is None else f"{{0,{r.max_gap}}}"
        raw = f"regexp_replace(regexp_extract(t, '{r.anchor}{r.gap}{reach}?({r.number}){r.unit}', 1), '[^0-9.]', '', 'g')"
        value = f"try_cast({raw} AS DOUBLE)"
        cols.append(f"{value if r.default is None else f'coalesce({value}, {r.default})'} AS {r.feature}")
    per_cat = ", ".join(
        f"coalesce(string_agg(text, ' ' ORDER BY doc_id) FILTER (lang = '{c}'), '') AS {c}" for c in categories
    )
    joined = " || ' ' || ".join(categories)
    return f"""WITH d AS ({source}), c AS (SELECT source, {per_cat} FROM d GROUP BY source),
        a AS (SELECT *, {joined} AS t FROM c) SELECT source, {', '.join(cols)} FROM a"""


def _features(docs, categories, counts, uniques, numbers):
    out = features.structural_features(
        docs, "source", "lang", "doc_id", "text", categories, counts, uniques, numbers
    )
    rounded = [c for c in out.columns if c.endswith(("_log", "_ratio", "_score")) and c != "overseas_sales_ratio"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


FIXTURE_RULES = (FIXTURE_CATEGORIES, FIXTURE_COUNTS, FIXTURE_UNIQUES, FIXTURE_NUMBERS)


@query("structural_features", _features_sql(*FIXTURE_RULES, "SELECT source, lang, doc_id, text FROM documents"))
def structural_features(spark, sf_dir):
    """Rules that fire on the fixture's prose; Spanish documents are of an unknown category."""
    return _features(table(spark, sf_dir, "documents"), *FIXTURE_RULES)


DEFAULT_RULES = (("top", "about", "ir", "news"), COUNT_RULES, UNIQUE_RULES, NUMBER_RULES)
LANG_CATEGORIES = {"en": "top", "fr": "about", "de": "ir", "es": "news"}
_LANG_SQL = "CASE lang WHEN 'en' THEN 'top' WHEN 'fr' THEN 'about' WHEN 'de' THEN 'ir' ELSE 'news' END AS lang"
# Frequent syllables of the prose become Japanese words, so that the built-in rules fire.
SYLLABLES = (
    ("the", "海外"), ("and", "拠点"), ("tion", "創業"), ("ent", "年"), ("ion", "国内シェア"), ("ing", "%"),
    ("er", "従業員"), ("on", "人"), ("eux", "連結子会社"), ("ou", "社"), ("en", "12"), ("le", "3"), ("an", "1937"),
    ("re", "事業"), ("th", "新規"), ("sch", "技術"), ("ai", "職"), ("st", "グローバル"), ("ed", "特許"), ("qu", "億円"),
)


def _japanese_sql() -> str:
    text = "text"
    for old, new in SYLLABLES:
        text = f"replace({text}, '{old}', '{new}')"
    return f"SELECT source, {_LANG_SQL}, doc_id, {text} AS text FROM documents"


def _routed(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in LANG_CATEGORIES.items() for x in kv])
    return table(spark, sf_dir, "documents").withColumn("lang", names[F.col("lang")])


@query(
    "structural_features_default",
    _features_sql(*DEFAULT_RULES, f"SELECT source, {_LANG_SQL}, doc_id, text FROM documents"),
)
def structural_features_default(spark, sf_dir):
    """The built-in rules over all documents, languages standing for page categories."""
    return _features(_routed(spark, sf_dir), *DEFAULT_RULES)


@query("structural_features_japanese", _features_sql(*DEFAULT_RULES, _japanese_sql()))
def structural_features_japanese(spark, sf_dir):
    """The built-in rules over all documents after frequent syllables became Japanese words."""
    text = F.col("text")
    for old, new in SYLLABLES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _features(_routed(spark, sf_dir).withColumn("text", text), *DEFAULT_RULES)


def _stated(doc_id: str, size: str) -> tuple[str, ...]:
    """Parts of a company profile whose numbers and words depend on the document; SQL that both engines read."""
    return (
        "' 海外売上高は約'", f"CAST({size} % 83 AS STRING)", "'.5% 海外拠点 '", f"CAST({doc_id} * 7 % 61 AS STRING)", "'ヶ所 創業は'",
        f"CAST(1850 + {size} % 150 AS STRING)", "'年 提携先：'", f"CAST({size} * 3 % 97 AS STRING)", "'社 '",
        f"repeat('昭和', CAST({size} % 4 AS INT))", f"repeat(' 兆円', CAST({doc_id} % 3 AS INT))", f"repeat(' 福利厚生 DX', CAST({size} % 5 AS INT))", f"repeat(' コンプライアンス', CAST({doc_id} % 4 AS INT))",
    )


_PROFILE_SQL = f"""SELECT source, {_LANG_SQL}, doc_id, {_japanese_sql().split(", doc_id, ")[1].removesuffix(" AS text FROM documents")}
                   || {" || ".join(_stated("doc_id", "n_chars"))} AS text FROM documents"""


@query("structural_features_profile", _features_sql(*DEFAULT_RULES, _PROFILE_SQL))
def structural_features_profile(spark, sf_dir):
    """The built-in rules over documents that state sales, bases, founding, partners, eras, sums and welfare."""
    text = F.col("text")
    for old, new in SYLLABLES:
        text = F.replace(text, F.lit(old), F.lit(new))
    parts = [F.expr(part) for part in _stated("doc_id", "n_chars")]
    return _features(_routed(spark, sf_dir).withColumn("text", F.concat(text, *parts)), *DEFAULT_RULES)
