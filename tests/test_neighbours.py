"""Neighbour search against brute force, with copies, ties and small blocks."""

import numpy as np
import pytest

from sitegauge.operators import neighbours as N
from sitegauge.plans import study_queries

SCHEMA = "id long, vec array<double>, grp int"


def cloud(seed, n=160, d=2, copies=50):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[: n // 2] = np.round(x[: n // 2], 1)  # ties
    x[r.choice(n, copies, replace=False)] = x[0]  # a third of all rows are copies
    return x


def frame(spark, x, grp):
    return spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, grp))], SCHEMA)


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize(("seed", "d", "folds", "block"), [(0, 2, 1, 10), (1, 2, 4, 7), (2, 5, 1, 25), (3, 3, 3, 1000)])
def test_nearest(spark, seed, d, folds, block):
    x = cloud(seed, d=d)
    grp = np.arange(len(x)) % folds
    df = frame(spark, x, grp)
    got = {}
    for r in N.nearest(df, df, 5, folds, block_points=block).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.distance))
    dist = distances(x)
    for i in range(len(x)):
        allowed = [j for j in range(len(x)) if (grp[j] != grp[i] if folds > 1 else j != i)]
        want = sorted(allowed, key=lambda j: (dist[i, j], j))[:5]
        mine = [n for _, n, _ in sorted(got[i])]
        assert mine == want, i
        assert np.allclose([s for _, _, s in sorted(got[i])], dist[i, want])


@pytest.mark.parametrize("block", [9, 1000])
def test_ranks(spark, block):
    x = cloud(5, n=90, copies=30)
    dist = distances(x)
    r = np.random.default_rng(1)
    pairs = [(int(i), int(j)) for i, j in r.integers(0, len(x), (150, 2)) if i != j]
    pairs = sorted(set(pairs))
    rows = [(i, x[i].tolist(), j, x[j].tolist()) for i, j in pairs]
    asked = spark.createDataFrame(rows, "id long, vec array<double>, neighbour long, neighbour_vec array<double>")
    points = frame(spark, x, np.zeros(len(x))).select("id", "vec")
    got = {(r.id, r.neighbour): r["rank"] for r in N.neighbour_ranks(asked, points, block).collect()}
    for i, j in pairs:
        closer = sum(dist[i, k] < dist[i, j] for k in range(len(x)) if k != i)
        assert got[i, j] == closer + 1


def test_ranks_read_their_pairs_once(spark):
    """The pairs come from a whole neighbour search; it must not run again for the last join."""
    x = cloud(6, n=60, copies=10)
    rows = [(i, x[i].tolist(), (i + j) % 60, x[(i + j) % 60].tolist()) for i in range(60) for j in range(1, 6)]
    pairs = spark.createDataFrame(rows, "id long, vec array<double>, neighbour long, neighbour_vec array<double>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = N.neighbour_ranks(pairs.mapInArrow(counted, pairs.schema), frame(spark, x, np.zeros(60)).select("id", "vec")).collect()
    assert len(found) == len(rows)
    assert seen.value == len(rows)


def test_trustworthiness_and_votes(spark):
    r = np.random.default_rng(3)
    high = r.normal(size=(80, 4))
    low = high[:, :2].copy()
    rows = [(i, h.tolist(), v.tolist()) for i, (h, v) in enumerate(zip(high, low))]
    df = spark.createDataFrame(rows, "id long, high array<double>, low array<double>")
    got = N.trustworthiness(df, 5, block_points=11).first()[0]
    dh, dl = distances(high), distances(low)
    n, cost = len(high), 0
    for i in range(n):
        near = sorted((j for j in range(n) if j != i), key=lambda j: (dl[i, j], j))[:5]
        order = sorted((j for j in range(n) if j != i), key=lambda j: dh[i, j])
        cost += sum(max(0, order.index(j) + 1 - 5) for j in near)
    assert got == pytest.approx(1 - 2 / (n * 5 * (2 * n - 16)) * cost)

    labels, folds = np.arange(n) % 3, np.arange(n) % 5
    df = spark.createDataFrame(
        [(i, low[i].tolist(), int(labels[i]), int(folds[i])) for i in range(n)], "id long, vec array<double>, label int, fold int"
    )
    votes = {r.id: r.pred for r in N.knn_predictions(df, 5, 5, block_points=13).collect()}
    for i in range(n):
        near = sorted((j for j in range(n) if folds[j] != folds[i]), key=lambda j: (dl[i, j], j))[:5]
        tally = np.bincount(labels[near], minlength=3)
        assert votes[i] == int(np.argmax(tally))


def test_empty_input_is_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        N.nearest(empty, empty, 3)


def test_group_study_joins_features_not_texts(spark, tmp_path):
    docs = [(1, "a b 12", 6), (1, "a b 12", 6), (2, None, None), (3, "", 0), (4, "x", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = study_queries._document_features(spark, str(tmp_path))
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "text#" not in above and "text#" in below
    one = (1, 1, *np.log1p([6, 3]), 2.0, np.log1p(2))
    want = [one, one, (2, 0, None, None, None, None), (3, 1, 0.0, np.log1p(1), 0.0, 0.0)]
    got = rows.select("doc_id", "quality", "chars_log", "words_log", "word_size", "digits_log").orderBy("doc_id").collect()
    for mine, its in zip(got, want, strict=True):
        assert [x is None for x in mine] == [x is None for x in its]
        assert [x for x in mine if x is not None] == pytest.approx([x for x in its if x is not None])
