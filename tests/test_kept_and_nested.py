"""Bucketed stream tables, nested hidden elements, binned densities, rules that fire, page types, ranking files."""

import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.functions.rules import COUNT_RULES, NUMBER_RULES, UNIQUE_RULES
from sitegauge.operators import companies, learn, metrics
from sitegauge.plans import text_queries
from sitegauge.sources import readers
from sitegauge.streaming.buckets import BucketedTable

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# ------------------------------------------------------------------ bucketed tables
def upsert(old, new):
    return old.join(new.select(F.col("k").alias("_k")).distinct(), F.col("k").eqNullSafe(F.col("_k")), "left_anti").unionByName(new)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def test_a_batch_reads_its_own_buckets_however_many_batches_came_before(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "k", frame(spark, []).schema, bucket_rows=10)
    table.merge(0, frame(spark, [(i, 0) for i in range(300)] + [(None, 0)]), upsert)
    read = []

    def watched(old, new):
        read.append(old.count())
        return upsert(old, new)

    for batch in range(1, 9):
        table.merge(batch, frame(spark, [(5, batch), (None, batch)]), watched)
    # The first of them finds too few buckets and deals all rows out anew; from then on two buckets are read.
    assert read[0] == 301 and max(read[1:]) == min(read[1:]) < 60
    rows = {r.k: r.v for r in table.current().collect()}
    assert len(rows) == 301 and rows[5] == rows[None] == 8 and rows[6] == 0
    folders = [f for f in os.listdir(f"{tmp_path}/index") if f.startswith("batch=")]
    assert len(folders) <= 3


def test_a_repeated_or_broken_batch_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "k", frame(spark, []).schema, bucket_rows=4)
    add = lambda old, new: old.unionByName(new)
    table.merge(0, frame(spark, [(i, 1) for i in range(40)]), add)
    for _ in range(2):
        table.merge(1, frame(spark, [(1, 2), (2, 2)]), add)
    assert table.current().count() == 42
    with pytest.raises(ZeroDivisionError):
        table.merge(2, frame(spark, [(1, 3)]), lambda old, new: 1 / 0)
    assert table.current().count() == 42 and table.current(batch_id=0).count() == 40
    table.merge(2, frame(spark, []), add)
    assert table.current().count() == 42


# ------------------------------------------------------------------ pages
@pytest.mark.parametrize(
    "page, text",
    [
        ("a<nav>b<nav>c</nav>d</nav>e", "a e"),
        ("a<NAV id='x'>b<nav/>c</nav>d</nav>e", "a e"),
        ("a<form>b<aside>c</form>d</aside>e", "a d e"),
        ("a</footer>b<footer>c", "a b"),
        ("a<script>'<nav>'</script>b<!-- <form> -->c", "a b c"),
        ("a<style>x<script>y</style>b</script>c", "a b c"),
        ("a<navigation>b</navigation>c<header-x>d", "a b c d"),
        ("<iframe>a<iframe>b</iframe>c", ""),
        ("no tags at all", "no tags at all"),
        ("x &hellip;&NotEqualTilde;&zzz;&amp;lt; &#x41;&nbsp;y", "x …≂̸&zzz;&lt; A y"),
        ("", ""),
    ],
)
def test_visible_text(spark, page, text):
    found = spark.createDataFrame([(page,)], "html string").select(H.html_text(F.col("html"))).first()[0]
    assert found == text


def test_deep_nesting_and_null_pages(spark):
    page = "start" + "<form><nav>" * 3000 + "in" + "</nav></form>" * 3000 + "<p>end</p>" * 2000
    began = time.time()
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(H.html_text(F.col("html")).alias("t")).collect()
    assert rows[0].t == "start" + " end" * 2000 and rows[1].t is None
    assert time.time() - began < 60


# ------------------------------------------------------------------ density
def test_binned_density_is_within_its_bound(spark):
    r = np.random.default_rng(4)
    values = [(0, float(v)) for v in r.normal(3, 2, 4000)] + [(None, float(v)) for v in r.exponential(5, 1500)] + [(1, 2.0)] * 5 + [(2, None)]
    df = spark.createDataFrame(values, "y int, v double").repartition(4)
    found = metrics.density_by_class(df, "y", "v", points=40, bins=16).collect()
    assert {q.y for q in found} == {0, None}
    for y in (0, None):
        x = np.array([v for c, v in values if c == y])
        h = x.std(ddof=1) * len(x) ** -0.2
        for q in (q for q in found if q.y == y):
            exact = np.exp(-(((q.x - x) / h) ** 2) / 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
            assert abs(q.density - exact) <= 0.4 / (8 * 16**2 * h)


# ------------------------------------------------------------------ rules, page types, files
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_every_rule_has_at_least_three_values(spark):
    rows = text_queries.structural_features_profile(spark, SF_DIR).toPandas()
    names = [r.feature for r in (*COUNT_RULES, *UNIQUE_RULES, *NUMBER_RULES)]
    few = {n: rows[n].unique().tolist() for n in names if rows[n].nunique(dropna=False) < 3}
    assert few == {}


def test_page_vectors_follow_the_schema(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, None], 5.0, None, 7.0, "x")], "c string, y int, top_vec array<double>, ir_vec_10 double, ir_vec_2 double, ir_vec_1 double, news_vec string")
    chosen = rows.select(*[companies.page_vector(rows, p).alias(p) for p in ("top", "ir")]).first()
    assert chosen.top == [1.0, 0.0] and chosen.ir == [7.0, 0.0, 5.0]
    assert companies.page_vector(rows, "news") is None and companies.page_vector(rows, "about") is None


def test_study_of_page_types(spark):
    r = np.random.default_rng(0)
    rows = [(i, i % 3, (r.normal(size=6) + 3 * (i % 3)).tolist(), *r.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows + [(60, 0, None, None, 1.0)], "k long, y int, top_vec array<double>, ir_vec_0 double, ir_vec_1 double")
    found = {(q.page_type, q.metric): q.value for q in learn.page_type_study(df, "k", "y").collect()}
    assert {p for p, _ in found} == {"top", "ir"}
    assert found["top", "companies"] == 61 and found["top", "with_page"] == 60 and found["ir", "with_page"] == 61
    assert found["top", "silhouette"] > 0.6 > 0.2 > found["ir", "silhouette"] and found["top", "map_knn_accuracy"] > 0.9


def test_ranking_files_of_both_shapes(spark, tmp_path):
    items = [{"name": f"n{i}", "value": i * 1.5} for i in range(250)] + [{"name": None, "value": None}, {"name": "only"}]
    (tmp_path / "wrapped.json").write_text(json.dumps({"data": items[:100], "total": 100}, indent=1))
    (tmp_path / "bare.json").write_text(json.dumps(items[100:]))
    (tmp_path / "none.json").write_text(json.dumps({"data": []}))
    rows = readers.read_ranking(spark, str(tmp_path)).collect()
    assert sorted((r.name or "", r.revenue or 0) for r in rows) == sorted((i.get("name") or "", i.get("value") or 0) for i in items)
