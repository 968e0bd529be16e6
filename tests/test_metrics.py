"""Cluster metrics and reports against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import learn, metrics


def points(seed=0, n=60, d=3):
    r = np.random.default_rng(seed)
    y = np.arange(n) % 3
    return r.normal(size=(n, d)) + 2 * y[:, None], y


def frame(spark, x, y):
    return spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "v array<double>, y int")


def silhouette(x, y, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    out = []
    for i in range(len(x)):
        same = [d[i, j] for j in range(len(x)) if y[j] == y[i] and j != i]
        if not same:
            out.append(0.0)
            continue
        a = np.mean(same)
        b = min(np.mean(d[i, y == c]) for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes(spark):
    x, y = points()
    y[-1] = 9  # a cluster of one
    df = frame(spark, x, y)
    assert metrics.silhouette(df, "y", "v").first().silhouette == pytest.approx(silhouette(x, y, True))
    assert metrics.silhouette_euclidean(df, "y", "v").first().silhouette == pytest.approx(silhouette(x, y, False), abs=1e-6)
    assert metrics.silhouette_euclidean(df.repartition(3), "y", "v", block_rows=7).first().silhouette == pytest.approx(silhouette(x, y, False), abs=1e-6)


def test_calinski_harabasz(spark):
    x, y = points(1)
    means = np.array([x[y == c].mean(0) for c in range(3)])
    between = sum((y == c).sum() * ((means[c] - x.mean(0)) ** 2).sum() for c in range(3))
    within = ((x - means[y]) ** 2).sum()
    want = (between / 2) / (within / (len(x) - 3))
    assert metrics.calinski_harabasz(frame(spark, x, y), "y", "v").first()[0] == pytest.approx(want)


def test_report_and_matrix(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(2, 0)]
    df = spark.createDataFrame(pairs, "y int, p int")
    report = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert report["0"].precision == pytest.approx(3 / 4) and report["0"].recall == pytest.approx(3 / 5)
    assert report["2"].precision == 0 and report["2"].f1 == 0 and report["2"].support == 1
    assert report["accuracy"].f1 == pytest.approx(0.7)
    assert report["macro avg"].recall == pytest.approx((0.6 + 1 + 0) / 3)
    matrix = {r["true"]: [r.pred_0, r.pred_1, r.pred_2] for r in metrics.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()}
    assert matrix == {0: [3, 2, 0], 1: [0, 4, 0], 2: [1, 0, 0]}
    assert sum(map(sum, matrix.values())) == sum(report[c].support for c in "012")


def test_density_integrates_to_one(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(c, float(v)) for c in "ab" for v in np.round(r.normal(size=200), 1)], "c string, v double")
    for c in "ab":
        curve = metrics.density_by_class(df, "c", "v").filter(F.col("c") == c).orderBy("point_no").collect()
        xs, ys = np.array([p.x for p in curve]), np.array([p.density for p in curve])
        assert ((ys[1:] + ys[:-1]) / 2 * np.diff(xs)).sum() == pytest.approx(1, abs=1e-2)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r.label: r.weight for r in learn.balanced_weights(df, "label").distinct().collect()}
    assert got == pytest.approx({0: 8 / 12, 1: 8 / 4})
