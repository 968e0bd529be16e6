"""Near duplicates by SimHash, found with vantage-point trees over Hamming distance.

A tree fitted on a bounded sample deals the fingerprints out to shards: at each node the points within a radius of the
vantage go inside, those further than the radius less the largest link distance go outside. By the triangle inequality
the two ends of a link are then together in at least one shard, the points in the overlap being in both. Each shard
builds its own tree the same way down to small leaves, compares those exactly, and gives the links of a spanning forest
(no link between components is lost, and never more rows than points). Components over all shards come from joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import free_name, map_batches, materialised, numbered, word_chunks
from sitegauge.llm.graph import components

SEED = 42
SHARD = 16_384
SAMPLE = 65_536
LEAF = 256
BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64 bits of a text: bit i is set if it is set in over half of the hashes of its shingles, repeats included."""
    ones, total, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_chunks(raw.lower()):
        words = carried + words
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in joined), dtype="<u8")
        ones += _ones(hashes)
        total += len(hashes)
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and carried:
        hashes = np.array([digest(b" ".join(carried), SEED)], dtype="<u8")
        ones, total = _ones(hashes), 1
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(parts) < 200:
        return np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(parts[:, j], minlength=256) @ BITS for j in range(8)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row_col: str | None = None) -> DataFrame:
    """row, doc_id, fp (the 64 bits as a signed long) for each input row; a null or wordless text has fingerprint 0.

    ``row`` is ``row_col``, or else the row's place in this one reading of ``docs``.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("raw"), row.alias("row"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch["raw"]], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(prints)], ["row", "doc_id", "fp"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, f"row long, doc_id {id_type}, fp long", each)


# --- vantage-point trees -------------------------------------------------------------------------------------------


def _split(points: np.ndarray, distance: int, rng: np.random.Generator):
    """The best vantage and radius of a few tries, or None where no split saves comparisons."""
    best = None
    for vantage in points[rng.integers(0, len(points), 6)]:
        far = np.bincount(np.bitwise_count(points ^ vantage), minlength=65)
        inside = np.cumsum(far)
        for radius in range(64):
            beyond = len(points) - (inside[radius - distance] if radius >= distance else 0)
            cost = float(inside[radius]) ** 2 + float(beyond) ** 2
            if best is None or cost < best[0]:
                best = (cost, vantage, radius)
    if best and best[0] > 0.8 * float(len(points)) ** 2:
        return None  # a dense ball: comparing it directly costs less than its overlaps
    return best and best[1:]


def _sides(points: np.ndarray, node, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points inside, and of those outside or in the overlap."""
    away = np.bitwise_count(points ^ node[0])
    return np.flatnonzero(away <= node[1]), np.flatnonzero(away > node[1] - distance)


def fit_tree(sample: np.ndarray, leaf: int, distance: int) -> tuple[list, int]:
    """Nodes (vantage, radius, inner, outer); a negative child -k-1 is shard k. Also the number of shards."""
    rng, nodes, shards = np.random.default_rng(SEED), [], 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        node = _split(points, distance, rng) if len(points) > leaf else None
        if node is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inner, outer = _sides(points, node, distance)
        nodes[at] = (*node, grow(points[inner]), grow(points[outer]))
        return at

    grow(sample)
    return nodes, shards


def route(points: np.ndarray, nodes: list, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of all points, several shards for those that lie in overlaps."""
    found, todo = [], [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, of = todo.pop()
        if at < 0:
            found.append((of, np.full(len(of), -at - 1)))
        elif len(of):
            inner, outer = _sides(points[of], nodes[at], distance)
            todo += [(nodes[at][2], of[inner]), (nodes[at][3], of[outer])]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _near(points: np.ndarray, distance: int):
    """Arrays of positions of pairs within the distance, tile by tile."""
    for i in range(0, len(points), 1024):
        for j in range(i, len(points), 4096):
            near = np.bitwise_count(points[i : i + 1024, None] ^ points[None, j : j + 4096]) <= distance
            a, b = np.nonzero(near)
            keep = a + i < b + j
            yield a[keep] + i, b[keep] + j


class Forest:
    """Components of the points 0..n-1 while pairs come in."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            np.minimum.at(self.up, a, b)
            while not np.array_equal(above := self.up[self.up], self.up):
                self.up = above


def linked(points: np.ndarray, distance: int, leaf: int = LEAF) -> np.ndarray:
    """For each of the distinct points the position of the first one of its component, by a tree over all of them."""
    rng, forest, todo = np.random.default_rng(SEED), Forest(len(points)), [np.arange(len(points))]
    while todo:
        of = todo.pop()
        node = _split(points[of], distance, rng) if len(of) > leaf else None
        if node is None:
            for a, b in _near(points[of], distance):
                forest.add(of[a], of[b])
        else:
            todo += [of[side] for side in _sides(points[of], node, distance)]
    return forest.up


# --- operators -----------------------------------------------------------------------------------------------------


def near_links(prints: DataFrame, distance: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the links between the distinct values of ``fp`` (signed longs).

    The dealing tree is fitted on at most about ``sample`` fingerprints; every fingerprint is dealt out by it.
    """
    count = prints.count()
    every = max(1, count // sample)
    drawn = prints.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * sample).collect()
    points = np.array(sorted(r.fp for r in drawn), dtype=np.int64).view(np.uint64)
    nodes, shards = fit_tree(points, max(8, shard // every), distance)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.asarray(batch["fp"]).view(np.uint64)
        at, to = route(values, nodes, distance)
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(values[at].view(np.int64))], ["shard", "fp"])

    def search(rows: pa.Table) -> pa.Table:
        values = np.sort(rows["fp"].to_numpy()).view(np.uint64)
        up = linked(values, distance)
        own = np.flatnonzero(up != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table({"a": signed[own], "b": signed[up[own]]})

    dealt = map_batches(prints.select("fp"), "shard long, fp long", deal)
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    shard: int = SHARD,
    row_col: str | None = None,
) -> DataFrame:
    """row, doc_id, fp, component_id, first_row: one row per input row, copies included.

    Two rows are linked if their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id that
    can be reached. ``first_row`` is the number of the row with that id that a caller keeping one row of each component
    should keep. A null text counts as empty, a null id is no candidate for the smallest unless the component has no other.
    Other columns are ignored. No rows in, no rows out.
    """
    prints = materialised(fingerprints(docs, id_col, text_col, shingle, row_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = materialised(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    links = materialised(near_links(distinct, distance, shard), "links")
    roots = components(links).select(F.col("node").alias("fp"), "root")
    of = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first").alias("least"))
    named = of.join(smallest, "root").select("fp", "least")
    return prints.join(named, "fp").select(
        "row", "doc_id", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first_row")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows with the smallest id of their component, one for each, with all their columns.

    The numbered rows are written once and read twice, so ``docs`` may be any frame.
    """
    key = free_name(docs, "near_row")
    docs = materialised(numbered(docs, key), "near-docs")
    groups = near_groups(docs, id_col, text_col, shingle, distance, row_col=key)
    gone = groups.where("row <> first_row").select(F.col("row").alias(key))
    return docs.join(gone, key, "left_anti").drop(key)
