"""Exact nearest neighbours and neighbour ranks without forming all pairs.

Queries and points are dealt into parts by hash, and each part of the one meets each part of the other in one task
(``pairs``). There both are cut into leaves, boxes of few rows that lie close together, and a leaf of queries visits the
leaves of points that can matter by the distance of the boxes. Copies of one vector are reduced before they become
candidates. Pruning is strong in the low-dimensional maps these metrics are meant for; for many dimensions it fades and the
work approaches one distance per pair, still exact and in bounded tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut_lineage
from . import pairs as P
from .ranking import first_k

BLOCK_POINTS = 2_000
# Rows of a leaf, of queries and of points: in few dimensions, and in many, where boxes prune little. A part has a share of
# the queries but all points, so a leaf of queries lies over many leaves of points.
_ASKED_LEAF, _LEAF, _LONG_LEAF, _FEW = 64, 256, 1_024, 8
_SLACK = 1e-7
_ROUND = 1e-6


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs; equal inputs give equal results wherever they are computed."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are set; for few of them much faster than ``nonzero`` of two dimensions."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in leaves of at most ``size``, halved along the widest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = x[at]
        half = len(at) // 2
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


def _leaf_rows(size: int, block_points: int) -> tuple[int, int]:
    """Most rows of a leaf of queries and of points, for vectors of ``size`` numbers."""
    asked, held = (_ASKED_LEAF, _LEAF) if size <= _FEW else (_LEAF, _LONG_LEAF)
    return min(block_points, asked), min(block_points, held)


class _Points:
    """The points of a part, leaf by leaf."""

    def __init__(self, vec: np.ndarray, size: int):
        leaves = _leaves(vec, size)
        self.order = np.concatenate(leaves)
        self.vec = vec[self.order]
        self.ends = np.cumsum([len(leaf) for leaf in leaves])
        self.starts = self.ends - [len(leaf) for leaf in leaves]
        self.low = np.minimum.reduceat(self.vec, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.vec, self.starts, axis=0)

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf the least and the largest squared distance that one of its points can have to one of ``x``."""
        low, high = x.min(axis=0), x.max(axis=0)
        least = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        most = np.maximum(self.high - low, high - self.low)
        return (least * least).sum(axis=1), (most * most).sum(axis=1)

    def rough(self, x: np.ndarray):
        """A function that gives a slice's squared distances to ``x`` in single precision, where that has the range, and what
        they may be off by."""
        middle = x.mean(axis=0)
        extent = max(np.abs(self.low - middle).max(), np.abs(self.high - middle).max(), np.abs(x - middle).max())
        kind = "float32" if extent < 1e15 else "float64"
        here = (x - middle).astype(kind)
        longest, share = (here * here).sum(axis=1).max(), (x.shape[1] + 8) * 2.0**-23

        def distances(part: slice) -> tuple[np.ndarray, float]:
            there = (self.vec[part] - middle).astype(kind)
            return P.squares(here, there), float(share * (longest + (there * there).sum(axis=1).max()) + 1e-30)

        return distances


def _points(points: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """The points as a written table, as several passes follow, with their number and the length of a vector."""
    points = cut_lineage(points, name)
    head = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not head["n"]:
        raise ValueError("no points")
    return points, head["n"], head["d"]


def nearest(
    queries: DataFrame, points: DataFrame, k: int, n_groups: int = 1, block_points: int = BLOCK_POINTS
) -> DataFrame:
    """``id, neighbour, distance, rank`` of the ``k`` nearest points; equal distances by id.

    Both inputs have ``id, vec, grp``. With several groups (folds) a query ignores the points
    of its own group; with one group it ignores only itself.
    """
    vec = A.doubles(F.col("vec"))
    # A list needs at most k points of one vector and group, plus the query itself.
    some = first_k(points.select("id", vec.alias("vec"), F.col("grp").cast("int").alias("grp")), ["vec", "grp"], ["id"], k + 1)
    held, n, size = _points(some.select("id", "vec", "grp"), "points")
    asked = queries.select("id", vec.alias("vec"), F.col("grp").cast("int").alias("grp"))
    folds, (leaf, long_leaf) = n_groups > 1, _leaf_rows(size, block_points)

    def best(ids: np.ndarray, x: np.ndarray, grp: np.ndarray, there: _Points, other: np.ndarray, their: np.ndarray):
        """For a leaf of queries: row, neighbour and distance of the nearest."""
        least, _ = there.reach(x)
        rough = there.rough(x)
        kth = np.full(len(x), np.inf)
        rows, cols, dist = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        for at in np.argsort(least):
            if least[at] > (kth * kth).max() * (1 + _SLACK):
                break
            part = slice(there.starts[at], there.ends[at])
            d, error = rough(part)
            most = kth * kth
            if np.isinf(most).any() and d.shape[1] > k:
                same = (grp[:, None] == their[None, part]) if folds else (ids[:, None] == other[None, part])
                most = np.minimum(most, np.partition(np.where(same, np.inf, d), k - 1, axis=1)[:, k - 1] + 2 * error)
            row, col = _places(d <= (most * (1 + _ROUND) + error).astype(d.dtype)[:, None])
            col += part.start
            apart = (grp[row] != their[col]) if folds else (ids[row] != other[col])
            row, col = row[apart], col[apart]
            if not len(row):
                continue
            rows, cols = np.concatenate([rows, row]), np.concatenate([cols, col])
            dist = np.concatenate([dist, _exact(x[row], there.vec[col])])
            order = np.lexsort((other[cols], dist, rows))
            kept = order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order], side="left") < k]
            rows, cols, dist = rows[kept], cols[kept], dist[kept]
            first = np.searchsorted(rows, np.arange(len(x) + 1))
            full = np.flatnonzero(np.diff(first) == k)
            kth[full] = dist[first[full] + k - 1]
        return ids[rows], other[cols], dist

    def visit(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        if asked.num_rows and held.num_rows:
            there = _Points(P.unpacked(held, "vec", "float64").reshape(-1, size), long_leaf)
            other, their = P.unpacked(held, "id", "int64")[there.order], P.unpacked(held, "grp", "int32")[there.order]
            ids, grp = P.unpacked(asked, "id", "int64"), P.unpacked(asked, "grp", "int32")
            x = P.unpacked(asked, "vec", "float64").reshape(-1, size)
            found += [best(ids[at], x[at], grp[at], there, other, their) for at in _leaves(x, leaf)]
        return pa.table({name: np.concatenate(v) for name, v in zip(("id", "neighbour", "distance"), zip(*found))})

    many = P.parts_for(asked.count(), size, block_points)
    found = P.meet(asked, many, held, P.parts_for(n, size), visit, "id long, neighbour long, distance double")
    return first_k(found, ["id"], ["distance", "neighbour"], k, out="rank", salts=1)


def neighbour_ranks(pairs: DataFrame, points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``id, neighbour, rank``: 1 + number of points strictly closer to ``id`` than ``neighbour``.

    ``pairs``: id, vec, neighbour, neighbour_vec. The pairs of one ``id`` are looked up together. Leaves wholly closer are
    counted from their totals, leaves wholly farther are skipped; only the others are visited.
    """
    vec, neighbour_vec = A.doubles(F.col("vec")), A.doubles(F.col("neighbour_vec"))
    distinct = points.groupBy(vec.alias("vec")).agg(F.count(F.lit(1)).alias("weight"))
    held, n, size = _points(distinct, "points")
    leaf, long_leaf = _leaf_rows(size, block_points)

    def distances(batches):
        for batch in batches:
            far = _exact(_matrix(batch["vec"]), _matrix(batch["neighbour_vec"])) if batch.num_rows else np.empty(0)
            columns = [batch["id"], batch["vec"], batch["neighbour"], pa.array(far), batch["own"]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "neighbour", "far", "own"])

    own = (A.squared_distance(vec, neighbour_vec) > 0).cast("int").alias("own")
    apart = pairs.select("id", vec.alias("vec"), "neighbour", neighbour_vec.alias("neighbour_vec"), own).mapInArrow(
        distances, "id long, vec array<double>, neighbour long, far double, own int"
    )
    listed = apart.groupBy("id", "vec").agg(F.sort_array(F.collect_list(F.struct("neighbour", "far", "own"))).alias("p"))
    # Written with all that is needed of the pairs, so that whatever finds them runs once.
    listed = cut_lineage(listed.select("id", "vec", *[F.col(f"p.{c}").alias(c) for c in ("neighbour", "far", "own")]), "asked")
    asked = listed.drop("own")

    def weights_within(x: np.ndarray, far: np.ndarray, there: _Points, weight: np.ndarray, totals: np.ndarray, alone: bool) -> np.ndarray:
        """For a leaf of queries the weight of points closer than each of their distances; a distance below 0 is none."""
        none, limit = far < 0, far * far
        least, most = there.reach(x)
        rough = there.rough(x)
        inside = most * (1 + _SLACK) < np.where(none, np.inf, limit).min()
        found = np.full(far.shape, totals[inside].sum())
        for at in np.flatnonzero(~inside & (least <= np.where(none, 0.0, limit).max() * (1 + _SLACK))):
            part = slice(there.starts[at], there.ends[at])
            d, error = rough(part)
            below = np.where(none, -np.inf, limit * (1 - _ROUND) - error).astype(d.dtype)
            above = np.where(none, -np.inf, limit * (1 + _ROUND) + error).astype(d.dtype)
            for j in range(far.shape[1]):
                under, up_to = d < below[:, j, None], d <= above[:, j, None]
                sure = np.count_nonzero(under, axis=1)
                found[:, j] += sure if alone else under @ weight[part]
                # Too close to call from rough distances: decide exactly.
                unsure = np.flatnonzero(np.count_nonzero(up_to, axis=1) > sure)
                if len(unsure):
                    row, col = _places(up_to[unsure] & ~under[unsure])
                    row, col = unsure[row], part.start + col
                    closer = _exact(x[row], there.vec[col]) < far[row, j]
                    np.add.at(found[:, j], row[closer], weight[col[closer]])
        return found

    def visit(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "int64"))]
        if asked.num_rows and held.num_rows:
            there = _Points(P.unpacked(held, "vec", "float64").reshape(-1, size), long_leaf)
            weight = P.unpacked(held, "weight", "int64")[there.order].astype("float64")
            totals, alone = np.add.reduceat(weight, there.starts), bool((weight == 1).all())
            ids, x = P.unpacked(asked, "id", "int64"), P.unpacked(asked, "vec", "float64").reshape(-1, size)
            times = P.unpacked(asked, "far_n", "int32")
            taken = np.arange(times.max()) < times[:, None]
            far, other = np.full(taken.shape, -1.0), np.zeros(taken.shape, "int64")
            far[taken], other[taken] = P.unpacked(asked, "far", "float64"), P.unpacked(asked, "neighbour", "int64")
            for at in _leaves(x, leaf):
                counts = weights_within(x[at], far[at], there, weight, totals, alone)
                real = taken[at]
                found.append((np.repeat(ids[at], times[at]), other[at][real], counts[real].astype("int64")))
        return pa.table({name: np.concatenate(v) for name, v in zip(("id", "neighbour", "closer"), zip(*found))})

    many = P.parts_for(asked.count(), size, block_points)
    counted = P.meet(asked, many, held, P.parts_for(n, size), visit, "id long, neighbour long, closer long")
    total = counted.groupBy("id", "neighbour").agg(F.sum("closer").alias("closer"))
    own = listed.select("id", F.explode(F.arrays_zip("neighbour", "own")).alias("p")).select("id", "p.neighbour", "p.own")
    # The point itself is closer than any neighbour at a positive distance.
    return total.join(own, ["id", "neighbour"]).select(
        "id", "neighbour", (F.col("closer") - F.col("own") + 1).alias("rank")
    )


def knn_predictions(points: DataFrame, k: int = 5, n_folds: int = 5, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Out-of-fold majority vote of the ``k`` nearest: ``id, label, fold, pred``.

    ``points``: id, vec, label, fold. Equal votes go to the lowest label.
    """
    spots = points.select("id", "vec", F.col("fold").alias("grp"))
    found = nearest(spots, spots, k, n_folds, block_points)
    labels = points.select(F.col("id").alias("neighbour"), F.col("label").alias("vote"))
    votes = found.join(labels, "neighbour").groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    winner = votes.groupBy("id").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("pred"))
    return points.select("id", "label", "fold").join(winner, "id")


def trustworthiness(points: DataFrame, k: int = 5, block_points: int = BLOCK_POINTS) -> DataFrame:
    """How far the neighbours in a map are neighbours in the original space, 0 to 1.

    ``points``: id, high, low. Each map neighbour outside the ``k`` nearest originals costs its
    original rank minus ``k``. Ranks count strictly closer points, so ties cost nothing.
    """
    low = points.select("id", F.col("low").alias("vec"), F.lit(0).alias("grp"))
    high = points.select("id", F.col("high").alias("vec"))
    pairs = (
        nearest(low, low, k, 1, block_points)
        .select("id", "neighbour")
        .join(high, "id")
        .join(high.select(F.col("id").alias("neighbour"), F.col("vec").alias("neighbour_vec")), "neighbour")
    )
    ranks = neighbour_ranks(pairs, high, block_points)
    cost = F.sum(F.greatest(F.col("rank") - k, F.lit(0)))
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    scale = 2.0 / (n * k * (2 * n - 3 * k - 1))
    return ranks.agg((1 - scale * F.coalesce(cost, F.lit(0))).alias("trustworthiness"))
