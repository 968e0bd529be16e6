"""Tables that meet part by part: every pair once, results as by brute force, and no more copies of the rows as they grow."""

import numpy as np
import pyarrow as pa
import pytest

from sitegauge.operators import metrics
from sitegauge.operators import neighbours as N
from sitegauge.operators import pairs as P


def vectors(seed, n, d=24):
    return np.random.default_rng(seed).normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, vec array<double>, grp int")


def test_rows_are_copied_no_more_often_as_they_grow():
    """A vector went to every block of 2,000 points before, and once for each of its pairs."""
    few, many = 20_000, 400_000
    copies = [P.parts_for(n, 2) + P.parts_for(n, 2, N.BLOCK_POINTS) for n in (5 * few, many)]
    assert copies[0] == copies[1] == P.ASKED_PARTS + 1
    assert P.parts_for(many, 64) + P.parts_for(many, 64, N.BLOCK_POINTS) <= 40
    assert P.parts_for(10 * P.PART_BYTES, 1) >= 80 and P.parts_for(0, 3) == 1


def test_every_pair_meets_once(spark):
    left, right = (spark.createDataFrame([(i, [float(i)] * (i % 3)) for i in range(n)], "k long, v array<double>").repartition(3) for n in (31, 17))

    def visit(a, b):
        x, y = P.unpacked(a, "k", "int64"), P.unpacked(b, "k", "int64")
        assert P.unpacked(a, "v_n", "int32").tolist() == (x % 3).tolist() and len(P.unpacked(a, "v", "float64")) == (x % 3).sum()
        return pa.table({"x": np.repeat(x, len(y)), "y": np.tile(y, len(x))})

    met = [(r.x, r.y) for r in P.meet(left, 4, right, 3, visit, "x long, y long").collect()]
    assert sorted(met) == [(i, j) for i in range(31) for j in range(17)]


def test_search_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 24 * 8 * 60)
    x = vectors(1, 200)
    x[:20] = x[150:170]
    x[20:60] = x[20]
    df = frame(spark, x)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = {i: sorted((j for j in range(200) if j != i), key=lambda j: (dist[i, j], j))[:4] for i in range(200)}
    found = N.nearest(df, df, 4, block_points=40)
    got = {i: [] for i in near}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r.id].append(r.neighbour)
    assert got == near
    asked = spark.createDataFrame([(i, x[i].tolist(), j, x[j].tolist()) for i in range(0, 200, 3) for j in (7, 30, 170) if i != j], "id long, vec array<double>, neighbour long, neighbour_vec array<double>")
    for r in N.neighbour_ranks(asked, df.select("id", "vec"), 40).collect():
        assert r["rank"] == 1 + sum(dist[r.id, k] < dist[r.id, r.neighbour] for k in range(200) if k != r.id)


@pytest.mark.parametrize("scale", [1e-12, 1e18])
def test_very_small_and_very_large_numbers(spark, scale):
    x = vectors(2, 90, 2) * scale
    df = frame(spark, x)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(r.id, r["rank"]): r.neighbour for r in N.nearest(df, df, 3, block_points=10).collect()}
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (dist[i, j], j))[:3]
        assert [got[i, n] for n in (1, 2, 3)] == want


def test_euclidean_silhouette_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 3 * 8 * 40)
    x, y = vectors(3, 150, 3), np.arange(150) % 4
    x[y == 3] = x[3]  # a cluster of copies: no point is apart from itself or from a copy
    x += y[:, None] + 1e4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sizes = np.bincount(y)
    own = np.array([d[i, y == y[i]].sum() / (sizes[y[i]] - 1) for i in range(150)])
    far = np.array([min(d[i, y == c].mean() for c in range(4) if c != y[i]) for i in range(150)])
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "v array<double>, y int").repartition(5)
    got = metrics.silhouette_euclidean(df, "y", "v", block_rows=16).first()
    assert got.n == 150 and got.silhouette == pytest.approx(((far - own) / np.maximum(own, far)).mean(), abs=1e-6)


def test_density_is_exact_without_bins(spark):
    r = np.random.default_rng(8)
    values = [(0, float(v)) for v in r.normal(3, 2, 300)] + [(1, float(v)) for v in r.integers(0, 9, 200)]
    found = metrics.density_by_class(spark.createDataFrame(values, "y int, v double"), "y", "v", points=30).collect()
    assert len(found) == 60
    for q in found:
        x = np.array([v for c, v in values if c == q.y])
        h = x.std(ddof=1) * len(x) ** -0.2
        assert q.density == pytest.approx(np.exp(-(((q.x - x) / h) ** 2) / 2).sum() / (len(x) * h * (2 * np.pi) ** 0.5), rel=1e-9)
