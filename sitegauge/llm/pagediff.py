"""Main text of web pages by differences to the page with the nearest URL, and what a page declares about itself.

Pages of a host with the same lines (blocks of text) count as one. Sorted by host and path over all tasks, each page is paired
with the one of its two neighbours on the host that shares more of the path. The lines of the pair are aligned by longest
common subsequence, and lines that both have are template and go. What a page declares protects and completes this: lines
of a declared article stay though shared, and lines outside it, or in declared menus, headers, footers, sidebars, notices,
adverts, forms or comments, go though no neighbour has them. Only digests of lines travel to the partner.
"""

from __future__ import annotations

import hashlib
import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import extended, free_name, map_batches, materialised, numbered
from sitegauge.llm.hosts import host_of, path_of

TOKEN = re.compile(r"<!--(?:.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ASIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "svg", "object", "video", "audio", "canvas", "map", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Class names and ids that declare something other than the article, alone or joined with each other or ``LAYOUT``.
LABELS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "popup", "modal", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "comment", "comments", "replies", "disqus", "newsletter", "subscribe", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "pagination", "pager", "skip", "toolbar", "widget",
}
LAYOUT = {"area", "bar", "block", "bottom", "box", "buttons", "container", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "right", "section", "site", "slot", "thread", "top", "unit", "wrapper"}
COMMENTS = {"comment", "comments", "replies", "disqus"}
ARTICLE = {"article", "main"}
#: Bits of the masks kept while a pair of pages is aligned.
MASK_BITS = 1 << 28
SALTS = 8
END_P = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "li", "footer", "nav", "aside", "form"}


def _declares(label: str, words: set[str]) -> bool:
    """Whether a class name or id is one of ``words``, or joins one with nothing but other labels and words of layout."""
    parts = set(re.split(r"[-_]+", label))
    return bool(parts & words) and parts <= LABELS | LAYOUT


def _zone(name: str, attributes: str, zone: str) -> str:
    """The zone within an element: ``article``, ``plain``, ``aside`` or ``comments``."""
    labels = {w for found in NAMES.findall(attributes) for w in "".join(found).lower().split()} if "=" in attributes else set()
    if zone == "comments" or any(_declares(w, COMMENTS) for w in labels):
        return "comments"
    labelled = any(_declares(w, LABELS) for w in labels)
    if name in ARTICLE or ("main" in labels and "role" in attributes.lower()):
        return "aside" if labelled else "article"
    if name in ASIDE or labelled or labels & ROLES or (name == "header" and zone != "article"):
        return "aside"
    return "aside" if HIDDEN.search(attributes) else zone


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the non-empty blocks of a page in order, references decoded and white space reduced."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    zone, at = "plain", 0

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            out.append((zone, text))
        parts.clear()

    while m := TOKEN.search(page, at):
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            if name in END_P and stack and any(n == "p" for n, _ in stack):
                k = max(i for i, (n, _) in enumerate(stack) if n == "p")
                if all(n in INLINE for n, _ in stack[k + 1 :]):
                    del stack[k:]
            stack.append((name, _zone(name, m[3] or m[6] or "", stack[-1][1] if stack else "plain")))
        zone = stack[-1][1] if stack else "plain"
    rest = page[at:]
    parts.append(rest if "<" not in rest else re.sub(r"<[a-zA-Z/!?].*", "", rest, flags=re.S))
    flush()
    return out


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """For every prefix of ``b`` the length of its longest common subsequence with ``a``, a bit of one number per element of ``b``."""
    n = len(b)
    full = v = (1 << n) - 1
    places: dict = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    masks: dict = {}
    for c in a:
        if c not in places:
            continue
        mask = masks.get(c)
        if mask is None:
            bits = np.zeros(n, dtype=np.uint8)
            bits[places[c]] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) * n > MASK_BITS:
                masks.clear()
            masks[c] = mask
        u = v & mask
        v = ((v + u) | (v - u)) & full
    kept = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - kept.astype(np.int64))])


def common_lines(own: list, other: list) -> set[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``, in space that grows as the lines do.

    ``own`` is halved, ``other`` cut where both halves together have most in common, and each pair of halves is treated alike.
    """
    low = 0
    while low < min(len(own), len(other)) and own[low] == other[low]:
        low += 1
    a, b = len(own), len(other)
    while min(a, b) > low and own[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
    found = set(range(low)) | set(range(a, len(own)))
    # What only one side has can't be in the subsequence.
    both = set(own[low:a]) & set(other[low:b])
    x = [i for i in range(low, a) if own[i] in both]
    left, right = [own[i] for i in x], [c for c in other[low:b] if c in both]
    todo = [(0, len(left), 0, len(right))]
    while todo:
        start, end, first, last = todo.pop()
        if start == end or first == last:
            continue
        if end - start == 1:
            if left[start] in right[first:last]:
                found.add(x[start])
            continue
        middle = (start + end) // 2
        ahead = _prefix_lengths(left[start:middle], right[first:last])
        behind = _prefix_lengths(left[middle:end][::-1], right[first:last][::-1])[::-1]
        cut = first + int(np.argmax(ahead + behind))
        todo += [(start, middle, first, cut), (middle, end, cut, last)]
    return found


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def _shared(one: str, other: str) -> int:
    n = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def nearest_pages(pages: DataFrame, row_col: str, *ties: str) -> DataFrame:
    """(row, mate): for each row of (row, host, path) the neighbour on its host, in the order of paths, that shares most of the path.

    Equal paths are ordered by the columns ``ties``; of two equally near neighbours the one before is taken.

    The order is made by ranges over all tasks; what meets at their borders is joined by two rows a task. Pages alone on
    their host have no mate; rows without a host are left out.
    """
    ordered = pages.where("host <> ''").repartitionByRange("host", "path", *ties, row_col).sortWithinPartitions("host", "path", *ties, row_col)
    ordered = ordered.select(F.spark_partition_id().alias("part"), F.col(row_col).alias("row"), "host", "path")

    def run(batches):
        """(row, mate, shared characters) within a task; its first and last row, marked 1, 2 or both 3, keep host and path."""
        names = ["part", "edge", "row", "host", "path", "mate", "near"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def line(before, own, after, edge):
            near = [(_shared(x[3], own[3]), -k, x[1]) for k, x in enumerate((before, after)) if x and x[2] == own[2]]
            best = max(near, default=(-1, 0, None))
            return {"part": own[0], "edge": edge, "row": own[1], "host": own[2] if edge else None, "path": own[3] if edge else None, "mate": best[2], "near": best[0]}

        before = own = None
        first = 1
        for batch in batches:
            out = []
            for after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is not None:
                    out.append(line(before, own, after, first))
                    first = 0
                before, own = own, after
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if own is not None:
            yield pa.RecordBatch.from_pylist([line(before, own, None, 2 + first)], schema=schema)

    found = materialised(ordered.mapInArrow(run, "part int, edge int, row long, host string, path string, mate long, near int"), "nearest")
    # Two rows a task meet across the borders: their number is that of the tasks.
    borders = sorted(found.where("edge > 0").collect(), key=lambda r: (r.part, r.edge))
    best = {r.row: (r.near, r.mate) for r in borders}
    for a, b in zip(borders, borders[1:], strict=False):
        if a.part != b.part and a.host == b.host:
            near = _shared(a.path, b.path)
            for own, other in ((a.row, b.row), (b.row, a.row)):
                if near > best[own][0]:
                    best[own] = (near, other)
    fixed = [(row, mate) for row, (_, mate) in best.items()]
    fixed = found.sparkSession.createDataFrame(fixed, "row long, mate long")
    return found.where("edge = 0").select("row", "mate").unionByName(fixed).where("mate is not null")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_to: str = "text") -> DataFrame:
    """Every row of ``pages`` with ``text``, ``n_chars`` and ``n_template``, its html and other columns as they were.

    The text are the lines of the article if the page declares one, else the lines outside declared asides, without those that
    the page with the nearest URL has too (lines of a declared article stay); ``n_template`` is how many lines of the page went
    for being shared. Blocks are joined by one space. Pages of a host with the same lines count as one, under the first of
    their paths, so repeated rows and mirrored pages get one result and never empty each other; of equally near pages the one
    before in the order of paths is compared, and pages under one path are ordered by a digest of their lines. Null or empty
    html gives an empty text. Such pages, pages without a host (null url), and those alone on their host are compared with none.
    Pages are matched by content, not by place, so the input may be any frame. Columns named like the new ones are replaced.
    """
    pages = pages.drop(text_to, "n_chars", "n_template")
    url = F.col(f"`{url_col}`")
    keyed = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(f"`{html_col}`").alias("html"))

    def key(digests: list[bytes]) -> bytes:
        return hashlib.blake2b(b"".join(digests), digest_size=16).digest()

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [[_digest(t) for _, t in blocks(x.as_py() or "")] for x in batch["html"]]
        return pa.RecordBatch.from_arrays(
            [batch["host"], batch["path"], pa.array(map(key, digests), pa.binary()), pa.array(digests, pa.list_(pa.binary()))],
            ["host", "path", "content", "lines"],
        )

    own = map_batches(keyed.where("host <> ''"), "host string, path string, content binary, lines array<binary>", lines)
    distinct = own.where(F.size("lines") > 0).groupBy("host", "content").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    distinct = materialised(numbered(distinct, "row"), "page-lines")
    mates = nearest_pages(distinct.select("row", "host", "path", "content"), "row", "content")
    other = distinct.select(F.col("row").alias("mate"), F.col("lines").alias("other"))
    pairs = mates.join(distinct.drop("path"), "row").join(other, "mate").select("host", "content", "lines", "other")

    def differ(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = []
        for a, b in zip(batch["lines"].to_pylist(), batch["other"].to_pylist(), strict=True):
            found = common_lines(a, b)
            shared.append([i in found for i in range(len(a))])
        return pa.RecordBatch.from_arrays([batch["host"], batch["content"], pa.array(shared, pa.list_(pa.bool_()))], ["host", "content", "shared"])

    shared = materialised(map_batches(pairs, "host string, content binary, shared array<boolean>", differ), "page-shared")

    host, content, salt, lines_to, article_to, gone = (
        free_name(pages, f"page_{c}") for c in ("host", "content", "salt", "lines", "article", "shared")
    )
    rows = pages.withColumn(host, host_of(url))

    def parsed(batches):
        """Rows with the digest of their lines, the lines that may be content (else null), and whether an article is declared."""
        for batch in batches:
            contents, kept, declared = [], [], []
            for x in batch[batch.schema.get_field_index(html_col)]:
                found = blocks(x.as_py() or "")
                wanted = "article" if any(z == "article" for z, _ in found) else "plain"
                contents.append(key([_digest(t) for _, t in found]))
                kept.append([t if z == wanted else None for z, t in found])
                declared.append(wanted == "article")
            new = [pa.array(contents, pa.binary()), pa.array(kept, pa.list_(pa.string())), pa.array(declared, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, content, lines_to, article_to])

    read = rows.mapInArrow(parsed, extended(rows, f"{content} binary, {lines_to} array<string>, {article_to} boolean"))
    # A page with very many copies is spread over the salts; any of the equal rows on the other side serves.
    read = read.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salted = shared.select(
        F.col("host").alias(host), F.col("content").alias(content), F.col("shared").alias(gone), F.explode(F.array(*map(F.lit, range(SALTS)))).alias(salt)
    )
    both = read.join(salted, [host, content, salt], "left")
    template = lambda i: F.coalesce(F.get(F.col(gone), i), F.lit(False))
    text = F.array_join(F.filter(lines_to, lambda t, i: t.isNotNull() & (F.col(article_to) | ~template(i))), " ")
    went = F.size(F.filter(lines_to, lambda t, i: template(i) & (t.isNull() | ~F.col(article_to)))).cast("long")
    both = both.select(*[F.col(f"`{c}`") for c in pages.columns], text.alias(text_to), went.alias("n_template"))
    return both.withColumn("n_chars", F.length(f"`{text_to}`").cast("long"))
