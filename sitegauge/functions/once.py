"""Keep costly expressions from being evaluated more than once.

The optimizer copies a column's definition into every filter and expression that uses it. For
cheap columns that is free; a chain of regular expressions over a whole page would run again for
each use. Values produced by a generator are not copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """The kept columns and the named values, each evaluated once per row.

    The outer form of ``explode`` is used because the plain one makes the optimizer test the
    size of its input first, which would evaluate it twice.
    """
    row = F.explode_outer(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_row")
    return df.select(*keep, row).select(*keep, *[F.col(f"_row.{n}").alias(n) for n in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
