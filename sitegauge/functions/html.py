"""HTML to text and link extraction as native expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let
from .text import collapse_spaces, strip

# Elements whose whole content is not page text.
DROPPED_ELEMENTS = ("script", "style", "header", "footer", "nav", "noscript", "aside", "form", "iframe")

# Their content is text whatever it looks like, so it ends at the first end tag.
RAW_ELEMENTS = ("script", "style")

_SPAN = r"{0}(?:[\s/][^>]*)?>.*?(?:</{0}\s*>|\z)"


def _hidden(elements: tuple[str, ...]) -> str:
    """Comments and the given elements with their content, whichever opens first; left open they run to the end."""
    spans = "|".join(_SPAN.format(e) for e in elements)
    return f"(?is)<(?:!--.*?(?:-->|\\z)|{spans})"


HIDDEN = _hidden(DROPPED_ELEMENTS)
HIDDEN_FROM_LINKS = _hidden(RAW_ELEMENTS)
NESTING_ELEMENTS = tuple(e for e in DROPPED_ELEMENTS if e not in RAW_ELEMENTS)
# Comments and raw elements as a whole, tags of the other dropped elements one by one.
HIDING = rf"{_hidden(RAW_ELEMENTS)}|</?(?:{'|'.join(NESTING_ELEMENTS)})(?:[\s/][^>]*)?>"
HIDING_NAME = rf"(?i)^</?({'|'.join(NESTING_ELEMENTS)})\b"
TAG = r"""<[/!?a-zA-Z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
STRAY_TAG = r"<[/!?a-zA-Z][^>]*>"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
HREF = r"""(?is)\A<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
FIRST_TEXT = r"(?is)\A<a\s[^>]*>(?:<[^>]*>)*([^<]*)"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"

_COMMON = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot")


def _entity_map() -> Column:
    """All named references of HTML5 that end in a semicolon, the common ones first; folded into a constant."""
    names = [*_COMMON, *sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in _COMMON)]
    return F.from_json(F.lit(json.dumps({n: html5[f"{n};"] for n in names})), "map<string,string>")


def _code_point(cp: Column) -> Column:
    ok = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return F.when(ok, char).otherwise(F.lit("�"))


def unescape(text: Column) -> Column:
    """Named and numeric character references, decoded once (``&amp;lt;`` becomes ``&lt;``)."""
    names = _entity_map()

    def decode(part: Column) -> Column:
        hexa = F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]{1,8});$", 1)
        deci = F.regexp_extract(part, "^&#([0-9]{1,9});$", 1)
        name = F.regexp_extract(part, "^&([A-Za-z][A-Za-z0-9]*);$", 1)
        return (
            F.when(~part.startswith("&"), part)
            .when(hexa != "", _code_point(F.conv(hexa, 16, 10).cast("long")))
            .when(deci != "", _code_point(deci.cast("long")))
            .otherwise(F.coalesce(F.try_element_at(names, name), part))
        )

    def decode_all(whole: Column) -> Column:
        parts = F.regexp_extract_all(whole, F.lit(r"(?s)&#?[A-Za-z0-9]+;|&|[^&]+"), F.lit(0))
        return F.when(whole.contains("&"), F.array_join(F.transform(parts, decode), "")).otherwise(whole)

    return let(text, decode_all)


# A noncharacter that no text holds; one that does has it read as a space.
_CUT = "\ufdd0"


def without_hidden(html: Column) -> Column:
    """The page with comments and dropped elements, whatever is nested in them, replaced by spaces.

    The tags that matter are set apart in one pass, and a fold over them keeps the name and depth of the
    element that hides: elements of the same name nest, others inside it are content. One that is left
    open hides all that follows; end tags of elements that are not open are dropped.
    """
    cut = F.regexp_replace(F.translate(html, _CUT, " "), HIDING, f"{_CUT}$0{_CUT}")

    def fold(parts: Column) -> Column:
        # Text and tags take turns: part 2k is the text before tag k, part 2k + 1.
        tags = F.transform(
            F.filter(parts, lambda p, i: i % 2 == 1),
            lambda t, k: F.struct(F.lower(F.regexp_extract(t, HIDING_NAME, 1)).alias("name"), t.startswith("</").alias("end"), (2 * k).alias("at")),
        )

        def step(state: Column, tag: Column) -> Column:
            opens = (state["depth"] == 0) & (tag["name"] != "") & ~tag["end"]
            same = (state["depth"] > 0) & (tag["name"] == state["name"])
            return F.struct(
                F.when(opens, tag["name"]).otherwise(state["name"]).alias("name"),
                F.when(opens, 1).when(same, state["depth"] + F.when(tag["end"], -1).otherwise(1)).otherwise(state["depth"]).alias("depth"),
                F.when(state["depth"] == 0, F.concat(state["shown"], F.array(tag["at"]))).otherwise(state["shown"]).alias("shown"),
            )

        start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("shown"))
        last = lambda s: F.when(s["depth"] == 0, F.concat(s["shown"], F.array(F.size(parts) - 1))).otherwise(s["shown"])
        return F.array_join(F.transform(F.aggregate(tags, start, step, last), lambda i: F.get(parts, i)), " ")

    return let(F.split(cut, _CUT, -1), fold)


def html_text(html: Column) -> Column:
    """Visible text: hidden elements and tags become spaces, references decoded, spaces collapsed."""
    body = without_hidden(html)
    body = F.regexp_replace(body, TAG, " ")
    body = F.regexp_replace(body, STRAY_TAG, " ")
    return F.trim(collapse_spaces(unescape(body)))


def anchors(html: Column) -> Column:
    """All ``<a>`` elements of the page, navigation included, scripts and comments excluded."""
    return F.regexp_extract_all(F.regexp_replace(html, HIDDEN_FROM_LINKS, " "), F.lit(ANCHOR), F.lit(0))


def anchor_href(anchor: Column) -> Column:
    raw = F.regexp_replace(F.regexp_extract(anchor, HREF, 1), """^["']|["']$""", "")
    return F.trim(unescape(raw))


def anchor_text(anchor: Column) -> Column:
    """First text node inside the anchor, stripped and lower-cased."""
    return F.lower(strip(unescape(F.regexp_extract(anchor, FIRST_TEXT, 1))))


def page_title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, TITLE, 1))


def first_link_in(html: Column, css_class: str, tag: str = "div") -> Column:
    """``href`` of the first anchor inside ``tag`` carrying ``css_class``; empty when absent."""
    opening = rf"""(?is)<{tag}\s(?:[^>]*?\s)?class\s*=\s*["'](?:[^"']*\s)?{css_class}(?:\s[^"']*)?["'][^>]*>"""
    blocks = F.regexp_extract_all(html, F.lit(opening + rf"(.*?)</{tag}\s*>"), F.lit(1))
    return anchor_href(F.regexp_extract(F.array_join(blocks, " "), r"(?is)(<a\s[^>]*>)", 1))
