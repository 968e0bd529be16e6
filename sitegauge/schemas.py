"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


COMPANY = _strings("company_name", "url", "revenue_class")
PAGE_TEXT = _strings("company_name", "revenue_class", "url", "page_category", "text_content")
CHUNK = _strings("company_name", "revenue_class", "page_category", "text")
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
RANKING_ITEM = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]
)
RANKING_ENVELOPE = T.StructType([T.StructField("data", T.ArrayType(RANKING_ITEM))])
CRAWL_SUMMARY = T.StructType(
    [
        T.StructField("pages_crawled", T.LongType()),
        T.StructField("found_categories", T.ArrayType(T.StringType())),
        T.StructField("text_length_total", T.LongType()),
    ]
)
CRAWL_RESULT = T.StructType(
    [
        T.StructField("texts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("summary", CRAWL_SUMMARY),
    ]
)
LABEL_MAPS = T.StructType(
    [
        T.StructField("revenue2id", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("category2id", T.MapType(T.StringType(), T.IntegerType())),
    ]
)
LABEL_ROW = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("id", T.IntegerType()),
    ]
)
CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
