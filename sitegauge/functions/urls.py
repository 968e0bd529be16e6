"""URL parts, resolution against a base and canonical form, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link targets that are files, not pages.
FILE_EXTENSIONS = ("pdf", "zip", "doc", "docx", "xls", "xlsx", "png", "jpg", "jpeg", "gif")


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)


def url_netloc(url: Column) -> Column:
    """User info, host and port, as written."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_file_link(href: Column) -> Column:
    return url_path(F.lower(href)).rlike(r"\.(" + "|".join(FILE_EXTENSIONS) + r")$")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(segments, -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == ".", kept)
        .when(seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(seg))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit(""))
    flat = F.concat(F.lit("/"), F.array_join(walked, "/"), tail)
    return F.when(path.rlike(r"/\.\.?(/|$)"), flat).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    origin = F.concat(url_scheme(base), F.lit("://"), url_netloc(base))
    base_path = url_path(base)
    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    return (
        F.when(url_scheme(href) != "", href)
        .when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(ref_path), ref_tail))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, ref_path)), ref_tail))
    )


def canonical_url(url: Column) -> Column:
    """Identity of a page for visiting it once: the address without its fragment."""
    return F.regexp_replace(url, "#.*$", "")
