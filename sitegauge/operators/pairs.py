"""Every row of one table against every row of another, in tasks of bounded size.

Both tables are dealt into parts by hash and packed, many rows to one row of bytes. Each part of the one meets each part of the
other in one group. The second table has as many parts as its bytes need, the first at least ``ASKED_PARTS`` where it has the
rows, so that there is work for all cores. What is shuffled is a constant times the input as long as a table fits
few parts of ``PART_BYTES``; beyond that it grows with the square of the parts, not of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 32 << 20
PART_ROWS = 1 << 20
ASKED_PARTS = 32


def parts_for(rows: int, size: int, block_rows: int | None = None) -> int:
    """Parts for so many vectors of ``size`` numbers; with ``block_rows`` up to ``ASKED_PARTS`` of no fewer rows than that."""
    fewest = max(-(-rows * 8 * size // PART_BYTES), -(-rows // PART_ROWS), 1)
    return max(fewest, min(ASKED_PARTS, -(-rows // block_rows))) if block_rows else fewest


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """``part`` and each column of ``rows`` as bytes, a list column also as the lengths of its lists (``<name>_n``)."""
    names = rows.columns
    dealt = rows.select("*", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int").alias("part"))
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    schema = ", ".join(["part int", *[f"`{n}` binary" for n in names], *[f"`{n}_n` binary" for n in lists]])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            missing = [n for n in names if batch[n].null_count]
            if missing:
                raise ValueError(f"a row has no {missing[0]}")
            part = batch["part"].to_numpy()
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            for at in np.split(order, edges):
                own = batch.take(pa.array(at))
                flat = {n: own[n].flatten() if n in lists else own[n] for n in names}
                raw = {n: c.to_numpy(zero_copy_only=False).tobytes() for n, c in flat.items()}
                raw |= {f"{n}_n": pc.list_value_length(own[n]).to_numpy().tobytes() for n in lists}
                columns = [pa.array([part[at[0]]], pa.int32()), *[pa.array([b], pa.binary()) for b in raw.values()]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", *raw])

    return dealt.mapInArrow(pack, schema)


def unpacked(packs: pa.Table, name: str, dtype: str) -> np.ndarray:
    """A packed column of a group, the values of its lists one after the other."""
    return np.frombuffer(b"".join(packs[name].to_pylist()), dtype=dtype)


def meet(
    asked: DataFrame, asked_parts: int, held: DataFrame, held_parts: int, visit: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``visit`` on the packs of every part of ``asked`` and of every part of ``held``."""
    left = packed(asked, asked_parts).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(held_parts - 1))))
    right = packed(held, held_parts).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    return left.groupBy("part", "with").cogroup(right.groupBy("with", "part")).applyInArrow(visit, schema)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product, in the precision of the vectors; rounding may leave some just below 0."""
    out = a @ (b.T * a.dtype.type(-2))
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None, :]
    return out
