"""Page-text records: filtering, chunking, ordered concatenation, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import FAILED_CATEGORY
from ..functions.text import fixed_chunks, strip
from .ranking import BLOCK_ROWS, counted_blocks, first_k, keep_first, null_safe_join, running_offset

CHUNK_CHARS = 400
MIN_CHUNK_CHARS = 50


def trainable(records: DataFrame, category: str = "page_category", text: str = "text_content") -> DataFrame:
    """Drop failure rows and rows without text."""
    return records.filter((F.col(category) != FAILED_CATEGORY) & (F.coalesce(F.col(text), F.lit("")) != ""))


def chunk_records(
    records: DataFrame,
    text: str,
    keep: list[str],
    width: int = CHUNK_CHARS,
    min_chars: int = MIN_CHUNK_CHARS,
) -> DataFrame:
    """One row per fixed-width piece: the kept columns, ``chunk_no`` and ``chunk``."""
    pieces = records.select(*keep, F.posexplode_outer(fixed_chunks(F.col(text), width)).alias("chunk_no", "chunk"))
    return pieces.filter(F.length("chunk") >= min_chars)


def ordered_concat(
    records: DataFrame,
    keys: list[str],
    order: str,
    text: str,
    part_chars: int = 1 << 20,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Texts of a group joined by one space in ``order``, cut into parts of ``part_chars``.

    ``keys, part_no, part_text``: the parts in order are the joined text exactly, and no part
    exceeds ``part_chars``, so a group of any size never meets in one task. ``order`` is unique in
    its group, of any type and with any gaps; blocks are counted, not cut by its values.
    """
    pieces = _placed_pieces(records, keys, order, text, block_rows)
    return _cut_and_join(pieces, keys, part_chars)


def category_order_concat(
    records: DataFrame,
    company: str,
    category: str,
    order: str,
    text: str,
    categories: tuple[str, ...],
    part_chars: int = 1 << 20,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like ``ordered_concat`` per company, but category by category in the given order.

    Every category takes part, so absent ones leave their separating space. Records of other
    categories are left out, companies that have no others keep the bare separators.
    """
    number = (F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)) - 1).cast("int")
    known = records.select(company, order, text, number.alias("_no"))
    chosen = known.filter(F.col("_no") >= 0)
    pieces = _placed_pieces(chosen, [company, "_no"], order, text, block_rows)
    # Lengths come from the records, so the texts are shuffled for the pieces only.
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    used = chosen.groupBy(company, "_no").agg((F.sum(length) + F.count(F.lit(1)) - 1).alias("_chars"))
    grid = records.select(company).distinct().withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(len(categories) - 1))))
    # One row per company and category: a window over a handful of rows.
    ahead = W.partitionBy(company).orderBy("_no").rowsBetween(W.unboundedPreceding, -1)
    starts = null_safe_join(grid, used, [company, "_no"], "left").select(
        company,
        "_no",
        F.coalesce(F.sum(F.coalesce("_chars", F.lit(0)) + 1).over(ahead), F.lit(0)).alias("_start"),
    )
    spaces = starts.filter(F.col("_no") > 0).select(
        company, (F.col("_start") - 1).alias("_at"), F.lit(" ").alias("_piece")
    )
    moved = null_safe_join(pieces, starts, [company, "_no"]).select(
        company, (F.col("_at") + F.col("_start")).alias("_at"), "_piece"
    )
    return _cut_and_join(moved.unionByName(spaces), [company], part_chars)


def _placed_pieces(records: DataFrame, keys: list[str], order: str, text: str, block_rows: int) -> DataFrame:
    """Each record's share of the joined text, ``_piece``, and where it starts, ``_at``.

    Starts are worked out on lengths alone; the texts meet them in one join.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = records.select(*keys, order, body.alias("_text"))
    sizes = counted_blocks(rows.select(*keys, order, F.length("_text").alias("_chars")), keys, order, "_block", block_rows)
    starts = running_offset(sizes, keys, "_block", [order], F.col("_chars") + 1, "_start").select(*keys, order, "_start")
    placed = null_safe_join(rows.hint("merge"), starts, [*keys, order])
    # Every record but the first brings the separator in front of it.
    piece = F.when(F.col("_start") == 0, F.col("_text")).otherwise(F.concat(F.lit(" "), F.col("_text")))
    start = F.when(F.col("_start") == 0, F.lit(0)).otherwise(F.col("_start") - 1)
    return placed.select(*keys, start.alias("_at"), piece.alias("_piece")).filter(F.col("_piece") != "")


def _cut_and_join(pieces: DataFrame, keys: list[str], part_chars: int) -> DataFrame:
    """Cut pieces at part borders and join what falls into the same part."""
    first_part = F.floor(F.col("_at") / part_chars)
    last_part = F.floor((F.col("_at") + F.length("_piece") - 1) / part_chars)
    cut = pieces.withColumn("part_no", F.explode(F.sequence(first_part, last_part)))
    lead = F.greatest(F.col("part_no") * part_chars - F.col("_at"), F.lit(0))
    stop = F.least((F.col("part_no") + 1) * part_chars - F.col("_at"), F.length("_piece").cast("long"))
    slices = cut.select(
        *keys,
        "part_no",
        F.struct(
            (F.col("_at") + lead).alias("at"),
            F.substring(F.col("_piece"), (lead + 1).cast("int"), (stop - lead).cast("int")).alias("text"),
        ).alias("_slice"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_slice")), lambda s: s["text"]), "")
    return slices.groupBy(*keys, "part_no").agg(joined.alias("part_text"))


def first_row_attributes(
    records: DataFrame, key: str, order: str, columns: list[str]
) -> DataFrame:
    """Attributes of the first record of each group."""
    return keep_first(records.select(key, order, *columns), [key], [order]).select(key, *columns)


def page_chunk_lists(
    records: DataFrame,
    keys: list[str],
    order: str,
    text: str,
    max_chunks: int = 15,
    width: int = CHUNK_CHARS,
    min_chars: int = MIN_CHUNK_CHARS,
) -> DataFrame:
    """First ``max_chunks`` chunks of each page group, as one ordered array."""
    chunks = chunk_records(records, text, [*keys, order], width, min_chars)
    # A record can place at most its own first chunks (only its last one can be too short), so
    # the others leave before the shuffle.
    near = chunks.filter(F.col("chunk_no") < max_chunks)
    kept = first_k(near, keys, [order, "chunk_no"], max_chunks)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk")))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda c: c["chunk"]).alias("chunks"))


def unpivot_texts(crawls: DataFrame, keys: list[str], texts: str = "texts") -> DataFrame:
    """``map<category, text>`` to one trimmed row per non-blank category."""
    rows = crawls.select(*keys, F.explode(texts).alias("page_category", "_raw"))
    trimmed = rows.select(*keys, "page_category", strip(F.col("_raw")).alias("text_content"))
    return trimmed.filter(F.col("text_content") != "")


def failure_rows(companies: DataFrame, failed: Column) -> DataFrame:
    """Marker rows for companies whose crawl gave nothing."""
    return companies.filter(failed).select(
        "company_name",
        "revenue_class",
        "url",
        F.lit(FAILED_CATEGORY).alias("page_category"),
        F.lit("").alias("text_content"),
    )


def saved_counts(records: DataFrame, keys: list[str], text: str = "text_content") -> DataFrame:
    """Saved categories and characters per group."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("saved_categories"), F.sum(F.length(text)).alias("saved_chars")
    )
