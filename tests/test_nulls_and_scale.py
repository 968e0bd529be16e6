"""Rows with null keys stay, and results don't depend on batch sizes, offsets or how records arrive."""

import math

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.operators import corpus, metrics, splits
from sitegauge.streaming import jobs


def test_null_labels_are_dealt_out_like_any_other(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None), (None, "y")], "company string, label string")
    folds = splits.stratified_folds(rows, "company", "label", folds=2).collect()
    assert len(folds) == 5 and sorted(r.fold for r in folds if r.label is None) == [0, 1]
    assert splits.split_companies(rows, "company", by="label").count() == 5


def test_null_keys_and_orders_keep_their_texts(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", None, "a"), (None, 1, "c"), (None, 5, "d")], "k string, o long, t string")
    joined = {r.k: r.part_text for r in corpus.ordered_concat(rows, ["k"], "o", "t").collect()}
    assert joined == {"k": "a b", None: "c d"}


def test_cross_entropy_counts_impossible_pages(spark):
    rows = spark.createDataFrame([([0.5, 0.5], 0), ([1.0, 0.0], 1)], "p array<double>, y int")
    want = (-math.log(0.5) - math.log(metrics.LEAST_PROBABILITY)) / 2
    assert metrics.cross_entropy(rows, "p", "y").first().cross_entropy == pytest.approx(want)


def test_cross_entropy_leaves_out_pages_without_label_or_probability(spark):
    rows = spark.createDataFrame([([0.5, 0.5], 0), (None, 1), ([0.9, 0.1], None), ([0.9], 1)], "p array<double>, y int")
    assert metrics.cross_entropy(rows, "p", "y").first().cross_entropy == pytest.approx(-math.log(0.5))
    assert metrics.cross_entropy(rows.where("p is null"), "p", "y").first().cross_entropy is None


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_cluster_metrics_far_from_zero(spark, offset):
    points = [(0, [0.0, 1.0]), (0, [1.0, 0.0]), (0, [0.5, 0.25]), (1, [8.0, 9.0]), (1, [9.0, 8.5]), (1, [8.5, 8.0])]
    near = spark.createDataFrame(points, "y int, v array<double>")
    far = near.withColumn("v", F.transform("v", lambda x: x + F.lit(offset)))
    for metric in (metrics.calinski_harabasz, metrics.silhouette):
        assert metric(far, "y", "v").first()[0] == pytest.approx(metric(near, "y", "v").first()[0], rel=1e-6)
    assert metrics.calinski_harabasz(near.where("y = 0"), "y", "v").first()[0] is None


def test_company_accuracy(spark):
    rows = spark.createDataFrame([("a", 0, [0.9, 0.1]), ("a", 0, [0.4, 0.6]), ("b", 1, [0.6, 0.4]), ("b", 1, [0.7, 0.3])], "c string, y int, p array<double>")
    found = metrics.company_accuracy(rows, "c", "y", "p").first()
    assert (found.accuracy, found.n) == (0.5, 2)


@pytest.mark.parametrize("files", [1, 1000])
def test_stream_results_do_not_depend_on_batches(spark, tmp_path, files):
    rows = [(1, "x" * 60), (2, "y"), (1, "x" * 60), (None, "z"), (3, "w")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "id long, t string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    schema = spark.createDataFrame([], "id long, t string").schema

    def results(name, build, distinct):
        stream = jobs.file_stream(spark, f"{tmp_path}/in/*.parquet", schema, files_per_batch=files)
        out = f"{tmp_path}/{name}"
        jobs.start_features(stream, "id", build, out, f"{out}-marks", distinct=distinct).awaitTermination()
        return sorted(((r.id or 0), r.n) for r in jobs.read_features(spark, out, "id").collect())

    total = lambda b: b.groupBy("id").agg(F.sum(F.length("t")).alias("n"))
    assert results("all", total, False) == [(0, 1), (1, 120), (2, 1), (3, 1)]
    assert results("one", total, True) == [(0, 1), (1, 60), (2, 1), (3, 1)]


def test_hidden_elements_left_open(spark):
    page = spark.createDataFrame([("<body>a<script>var x=1; secret()</body>",)], "html string")
    assert page.select(H.html_text(F.col("html"))).first()[0] == "a"
