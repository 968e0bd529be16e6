"""Exact duplicates of whole texts by skew-safe combining.

Copies are merged three times: within a task (the map side of the first grouping), within a salt, and over the salts.
Each of these groupings has the whole text in its key, so two texts are merged only if their contents are equal; the
digest leads the key to make comparing cheap. A text with a billion copies reaches the last step as one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import materialised, text_or_empty

SALTS = 16
HOT = 1000


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """id, text, everything else, and for each row its number, salt and digest."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    return (
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            text_or_empty(F.col(f"`{text_col}`")).alias("text"),
            F.struct(F.col(f"`{text_col}`").isNull().alias("was_null"), *rest).alias("rest"),
        )
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn("digest", digest(F.col("text")))
    )


def _winners(keyed: DataFrame, carry: bool) -> DataFrame:
    """One row per distinct text: the largest (id, row number), the number of rows and, if wanted, the other columns."""
    best = F.struct("id", "row")
    firsts = [F.max(best).alias("best"), F.count("*").alias("n")] + [F.max_by("rest", best).alias("rest")] * carry
    merged = [F.max("best").alias("top"), F.sum("n").alias("n")] + [F.max_by("rest", "best").alias("rest")] * carry
    salted = keyed.groupBy("digest", "salt", "text").agg(*firsts)
    return salted.groupBy("digest", "text").agg(*merged).withColumnRenamed("top", "best")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = _sha,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, copies included.

    Of equal texts the row with the largest id stays; of rows equal in id and text exactly one stays. A null text counts as
    an empty one, a null id is smaller than any other. Other columns are ignored, whatever their names. No rows in, no rows out.
    Groups are rejoined by content, and rows are numbered in one written table, so ``docs`` may be any frame.
    """
    keyed = _keyed(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, salts, digest)
    keyed = keyed.withColumns({"sha": _sha(F.col("text")), "doubt": F.lit("")})
    won = materialised(_winners(keyed, carry=False).select("digest", "n"), "exact-winners")
    # Different texts under one digest: not seen with SHA-256, but never merged either; there the text is part of the key.
    shared = materialised(won.groupBy("digest").count().where("count > 1").select("digest"), "exact-shared")
    narrow, key = ["id", "row", "digest", "doubt", "sha"], ["digest", "doubt"]
    if shared.isEmpty():
        rows, groups = keyed.select(*narrow), won.withColumn("doubt", F.lit(""))
    else:
        doubted = keyed.join(shared, "digest", "left_semi").withColumn("doubt", F.col("text"))
        rows = keyed.join(shared, "digest", "left_anti").select(*narrow).unionByName(doubted.select(*narrow))
        by_text = _winners(doubted, carry=False).select("digest", F.col("text").alias("doubt"), "n")
        groups = won.join(shared, "digest", "left_anti").withColumn("doubt", F.lit("")).unionByName(by_text)
    rows = materialised(rows, "exact-rows")
    top = rows.groupBy(*key).agg(F.max(F.struct("id", "row")).alias("best"))
    groups = materialised(groups.join(top, key), "exact-groups")
    # Fewer than HOT groups can have more than one in HOT of the rows: small enough to go to every task. The rest has no hot key.
    many = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("n") * HOT > many))
    usual = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col("n") * HOT <= many), key)
    return rows.join(hot, key).unionByName(usual).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns; the same choice as ``exact_groups``, in one pass over the texts."""
    won = _winners(_keyed(docs, id_col, text_col, salts, _sha), carry=True)
    back = {id_col: F.col("best.id"), text_col: F.when(~F.col("rest.was_null"), F.col("text"))}
    for i, name in enumerate(c for c in docs.columns if c not in (id_col, text_col)):
        back[name] = F.col(f"rest.c{i}")
    return won.select(*[back[c].alias(c) for c in docs.columns])
