"""Blocks by counting, estimates from pages, components, selection: against direct computation."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions.html import html_text
from sitegauge.operators import corpus, estimate, learn, metrics, ranking, vectors
from sitegauge.operators.features import structural_features


def hashed(i):
    return hashlib.md5(str(i).encode()).hexdigest()


@pytest.fixture(scope="module")
def hot(spark):
    """A company with two thirds of all rows, a null one, ids without any order or density."""
    rows = [("hot" if i % 3 else (None if i % 2 else f"c{i % 7}"), hashed(i), f"text {i}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, id string, t string").repartition(9)


def test_hashed_ids_give_full_blocks(hot):
    rows, df = hot
    sizes = Counter(k for k, *_ in rows)
    found = defaultdict(Counter)
    for r in ranking.counted_blocks(df, ["k"], "id", "b", 100).collect():
        found[r.k][r.b] += 1
    for k, n in sizes.items():
        assert sorted(found[k]) == list(range(-(-n // 100)))
        assert [found[k][b] for b in range(n // 100)] == [100] * (n // 100)


def test_positions_of_equal_and_null_orders(spark):
    rows = [("a", 5)] * 500 + [("a", None), ("a", 1), (None, 3), (None, None)]
    df = spark.createDataFrame(rows, "k string, o long").repartition(5)
    out = ranking.row_positions(df, ["k"], ["o"], "p", total="n").collect()
    assert sorted(r.p for r in out if r.k == "a") == list(range(502)) and {r.n for r in out if r.k == "a"} == {502}
    assert {(r.o, r.p) for r in out if r.k is None} == {(None, 0), (3, 1)}
    assert {r.o: r.p for r in out if r.k == "a" and r.o != 5} == {None: 0, 1: 1}
    assert ranking.row_positions(df.limit(0), ["k"], ["o"], "p").collect() == []


def test_joined_text_of_a_hot_company_with_hashed_ids(hot):
    rows, df = hot
    parts = defaultdict(dict)
    for r in corpus.ordered_concat(df, ["k"], "id", "t", part_chars=700, block_rows=64).collect():
        parts[r.k][r.part_no] = r.part_text
    for k in {k for k, *_ in rows}:
        want = " ".join(t for own, _, t in sorted(rows, key=lambda r: r[1]) if own == k)
        assert "".join(parts[k][i] for i in sorted(parts[k])) == want


def test_features_do_not_depend_on_the_values_of_seq(spark):
    texts = ["従業員数", "：1,234名", "創業は", "1937年 海外", "拠点", "グローバル 事業"]
    dense = [("x" if i % 4 else "y", "top" if i % 5 else "about", i, texts[i % 6]) for i in range(240)]
    steps = np.cumsum(np.random.default_rng(3).integers(1, 1 << 50, 240)).tolist()
    schema = "company string, category string, seq long, text string"
    of = lambda rows: sorted(structural_features(spark.createDataFrame(rows, schema), "company", "category", "seq", "text", block_rows=7).collect())
    assert of(dense) == of([(a, b, steps[i], t) for a, b, i, t in dense])


def test_as_many_labels_as_rows(spark):
    df = spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("l")).repartition(7)
    ids = ranking.label_ids(df, "l").orderBy("label").collect()
    assert [r.id for r in ids] == list(range(20_000))


MODEL = estimate.Estimator(vectors.hashing_encoder(8), 8, lambda v: F.get(v, F.lit(0)), vectors.seeded_weights(8, 8, 5, 4, 6))


def test_estimates_from_pages(spark):
    rows = [
        ("a", "top", 1, "<p>" + "alpha beta " * 30 + "</p>"), ("a", "ir", 2, "<p>short</p>"), ("a", None, 3, "<p>" + "other words " * 20 + "</p>"),
        ("b", "top", 4, ""), ("c", "ir", 5, "<p>" + "x" * 9000 + "</p>"), ("c", "ir", 6, "<p>" + "never read " * 30 + "</p>"),
    ]
    pages = spark.createDataFrame(rows, "company string, category string, seq long, html string").select("company", "category", "seq", html_text(F.col("html")).alias("text"))
    out = estimate.company_estimates(pages, "company", "category", ["seq"], "text", MODEL)
    # What follows reads the stored texts; no page is parsed again.
    assert "noscript" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.company: r for r in out.collect()}
    assert {c: r.status for c, r in got.items()} == {"a": "ok", "b": "no_text", "c": "ok"}
    assert got["a"].features_summary.asDict() == {"pages_crawled": 3, "found_categories": ["top"], "text_length_total": 1 + 329 + 1 + 239}
    assert got["c"].features_summary.asDict() == {"pages_crawled": 2, "found_categories": ["ir"], "text_length_total": 5001}
    assert got["b"].features_summary.asDict() == {"pages_crawled": 1, "found_categories": [], "text_length_total": 0}
    assert got["a"].n_pages == got["c"].n_pages == 1 and got["b"].estimated_class is None


@pytest.mark.parametrize("rank", [200, 7])
def test_components_against_svd(spark, rank):
    r = np.random.default_rng(rank)
    x = r.normal(size=(400, rank)) @ r.normal(size=(rank, 200)) + 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "id long, v array<double>").repartition(5)
    fitted = learn.fit_pca(df, "v", 5, extra=3, tolerance=1e-9)
    u, s, w = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert fitted.residual < 1e-8
    assert np.allclose(fitted.variances, s[:5] ** 2 / 400)
    scores = learn.project(df, "v", fitted, "s").orderBy("id").collect()
    assert scores[-1].s is None
    assert np.allclose(np.abs(np.array([q.s for q in scores[:-1]])), np.abs(u[:, :5] * s[:5]), atol=1e-4)


def test_selection_by_company_accuracy_from_stored_probabilities(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i // 3, int(i // 3) % 3, (r.normal(size=4) + 1.2 * ((i // 3) % 3)).tolist()) for i in range(180)]
    chosen = learn.select_classifier(spark.createDataFrame(rows, "c long, y int, v array<double>"), "c", "y", "v", (0.0, 0.5), folds=3, max_iter=15)
    chosen.held_out.write.parquet(f"{tmp_path}/p")
    found = duckdb.sql(f"""
        WITH d AS (SELECT candidate, fold, c, label, unnest(probs) AS p, unnest(range(3)) AS k FROM '{tmp_path}/p/*.parquet'),
        m AS (SELECT candidate, fold, c, any_value(label) AS label, k, avg(p) AS p FROM d GROUP BY candidate, fold, c, k),
        b AS (SELECT candidate, fold, c, any_value(label) AS label, arg_max(k, p) AS pred FROM m GROUP BY ALL),
        f AS (SELECT candidate, fold, avg((label = pred)::INT) AS a, count(*) AS n FROM b GROUP BY ALL)
        SELECT candidate, avg(a), sum(n) FROM f GROUP BY candidate ORDER BY candidate""").fetchall()
    assert [(c, n) for c, _, n in found] == [(0, 60), (1, 60)]
    stored = {q.candidate: q.accuracy for q in chosen.candidates.collect()}
    assert all(stored[c] == pytest.approx(a) for c, a, _ in found) and max(stored.values()) > 0.6
    # A company is held out whole.
    assert chosen.held_out.groupBy("c").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


def test_euclidean_silhouette_has_no_row_limit(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(700, 3)), r.integers(0, 3, 700)
    x += 3 * y[:, None]
    df = spark.createDataFrame([(v.tolist(), None if c == 2 else int(c)) for v, c in zip(x, y, strict=True)], "v array<double>, y int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.array([d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1) for i in range(700)])
    far = np.array([min(d[i, y == c].mean() for c in range(3) if c != y[i]) for i in range(700)])
    want = ((far - own) / np.maximum(own, far)).mean()
    assert metrics.silhouette_euclidean(df.repartition(6), "y", "v", block_rows=50).first().silhouette == pytest.approx(want)
