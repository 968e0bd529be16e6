"""Order-dependent operators that stay safe when one group holds a large share of all rows.

A plain window over a hot key sorts the whole group in one task. These helpers split a
group into ordered blocks of bounded size, work inside blocks, and combine only block
totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 10_000


def running_offset(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Sum of ``value`` over the preceding rows of the group (exclusive prefix sum).

    ``block`` must be non-decreasing along ``order``. Rows are shuffled once, on keys and
    block; the window over a whole group sees one row per block. A null key is a group like any
    other, rows with a null order come first.
    """
    valued = df.withColumn("_value", value)
    totals = valued.groupBy(*keys, block).agg(F.sum("_value").alias("_block_sum"))
    ahead = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *keys, block, F.coalesce(F.sum("_block_sum").over(ahead), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        null_safe_join(valued, base, [*keys, block])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_base")
    )


def row_positions(
    df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None
) -> DataFrame:
    """Zero-based position of each row in its group, whatever the values of ``order`` are.

    Rows are dealt out by ranges of (keys, order) and written in that order; a row's position
    is then its place in its part plus the rows of the group in earlier parts, which a table
    with one row per part and group tells. A hot group spans many parts, and so do rows that
    are equal in keys and order (those get positions in any order). Null keys are a group,
    null orders come first. ``total`` names a column for the rows of the group. No rows give none.
    """
    tied = df.withColumn("_place_tie", F.monotonically_increasing_id())
    by = [F.col(f"`{c}`") for c in [*keys, *order, "_place_tie"]]
    placed = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_place_tie")
    placed = cut_lineage(placed.withColumn("_place_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_place_part", F.shiftright("_place_at", 33))
    parts = placed.groupBy(*[f"`{k}`" for k in keys], "_place_part").agg(
        F.min("_place_at").alias("_place_first"), F.count("*").alias("_place_rows")
    )
    whole = W.partitionBy(*[f"`{k}`" for k in keys])
    ahead = whole.orderBy("_place_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_place_base", F.coalesce(F.sum("_place_rows").over(ahead), F.lit(0)))
    parts = parts.withColumn("_place_total", F.sum("_place_rows").over(whole)).drop("_place_rows")
    found = null_safe_join(placed, parts, [*keys, "_place_part"])
    found = found.withColumn(out, F.col("_place_base") + F.col("_place_at") - F.col("_place_first"))
    if total:
        found = found.withColumn(total, F.col("_place_total"))
    return found.drop("_place_at", "_place_part", "_place_first", "_place_base", "_place_total")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by name where null equals null; the columns of ``left``, then the others of ``right``."""
    there = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(there[f"_right_{c}"]) for c in keys], F.lit(True))
    return left.join(there, same, how).drop(*[f"_right_{c}" for c in keys])


def group_rank(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Zero-based position inside the group by a unique column of any type, null first."""
    return row_positions(df, keys, [order], out)


def hash_rank(df: DataFrame, key: str, by: list[str], seed: int, out: str) -> DataFrame:
    """Zero-based pseudo-random position by ``md5(key|seed)`` inside each ``by`` group."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return row_positions(df.withColumn("_digest", digest), by, ["_digest", key], out).drop("_digest")


def counted_blocks(df: DataFrame, keys: list[str], order: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of the block of ``block_rows`` rows that a row falls into, in ``order`` inside its group.

    Rows are counted, so a group of n rows has ``ceil(n / block_rows)`` blocks whether its orders
    are dense, sparse or hashes. Only keys and order are dealt out by range; the rows themselves
    meet their block numbers in one join, for which ``order`` must be unique in a group.
    """
    return null_safe_join(df.hint("merge"), block_numbers(df.select(*keys, order), keys, order, out, block_rows), [*keys, order])


def block_numbers(df: DataFrame, keys: list[str], order: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keys, order and block number of every row; as many rows as ``df``, so join them by shuffling both."""
    places = row_positions(df.select(*keys, order), keys, [order], "_pos")
    return places.select(*keys, order, F.floor(F.col("_pos") / block_rows).alias(out))


def first_k(
    df: DataFrame, keys: list[str], order: list[str], k: int, out: str = "rank", salts: int = 16
) -> DataFrame:
    """First ``k`` rows of each group by ``order`` with their 1-based rank.

    Two rounds: the group limit runs per map task, then per salted sub-group, so a hot group
    never meets in one task before it has shrunk to ``k * salts`` rows.
    """
    salt = F.pmod(F.xxhash64(*[F.col(o) for o in order]), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", salt)
    near = W.partitionBy(*keys, "_salt").orderBy(*order)
    near_k = salted.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= k)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        near_k.drop("_salt", "_near")
        .withColumn(out, F.row_number().over(final))
        .filter(F.col(out) <= k)
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per group, the first by ``order``.

    An aggregate, not a window: map tasks already reduce each group to one row.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels as text, sorted, numbered from 0; null is no label. There may be as many labels as rows."""
    domain = df.select(F.col(label).cast("string").alias("label")).filter(F.col("label").isNotNull()).distinct()
    return row_positions(domain, [], ["label"], "id").select("label", F.col("id").cast("int").alias("id"))


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Union by name; columns absent from a frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
