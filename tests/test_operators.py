"""Chunks, ordered texts, budget, frontier, scoring, learning, files and streams on small inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import arrays as A
from sitegauge.functions.text import fixed_chunks, is_blank, strip
from sitegauge.operators import companies, corpus, crawl, learn, metrics, ranking, splits, tfidf, vectors
from sitegauge.sources import readers, writers
from sitegauge.streaming import jobs


def test_chunks_rejoin_to_the_text(spark):
    texts = ["", "a", "𠮷野家" * 300, "x" * 400, "y\n" * 401]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fixed_chunks(F.col("t"), 400).alias("c"))
    for r in rows.collect():
        assert "".join(r.c) == r.t
        assert [len(c) for c in r.c] == [len(r.t[i : i + 400]) for i in range(0, len(r.t), 400)]


def test_strip_and_blank(spark):
    row = spark.createDataFrame([("　 a b \n", " 　\n")], "a string, b string").select(
        strip(F.col("a")).alias("a"), is_blank(F.col("a")).alias("x"), is_blank(F.col("b")).alias("y")
    ).first()
    assert tuple(row) == ("a b", False, True)


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_ordered_concat(spark, part):
    r = random.Random(part)
    rows = [("hot" if i % 4 else f"k{i % 3}", i, r.choice(["", "a", "𠮷", "word " * r.randrange(4)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, seq long, t string")
    out = corpus.ordered_concat(df, ["k"], "seq", "t", part_chars=part, block_rows=9)
    got = {}
    for row in out.orderBy("k", "part_no").collect():
        assert len(row.part_text) <= part
        got[row.k] = got.get(row.k, "") + row.part_text
    for k in {x[0] for x in rows}:
        assert got.get(k, "") == " ".join(t for key, _, t in sorted(rows, key=lambda x: x[1]) if key == k)


@pytest.mark.parametrize("part", [3, 500])
def test_category_order_concat(spark, part):
    r = random.Random(part)
    cats = ("x", "y", "none", "z")
    rows = [(f"k{i % 5}", r.choice(["x", "y", "z", "other"]), i, r.choice(["", "a", "bb c"])) for i in range(80)]
    rows.append(("only-other", "other", 99, "text"))
    df = spark.createDataFrame(rows, "k string, c string, seq long, t string")
    got = {}
    for row in corpus.category_order_concat(df, "k", "c", "seq", "t", cats, part, 7).orderBy("k", "part_no").collect():
        got[row.k] = got.get(row.k, "") + row.part_text
    for k in {x[0] for x in rows}:
        want = " ".join(" ".join(t for key, cat, _, t in rows if key == k and cat == c) for c in cats)
        assert got[k] == want


def test_budget(spark):
    r = random.Random(3)
    rows = [(f"c{i % 3}", i, "x" * r.choice([10, 50, 51, 60, 200, 6000])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, t string")
    got = {x.k: x.text for x in crawl.budget_texts(df, ["k"], ["seq"], "t", budget=700).collect()}
    for k in got:
        acc = ""
        for _, _, t in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            if len(t) > 50 and len(acc) < 700:
                acc += " " + t[:700]
        assert got[k] == acc


def test_frontier_budget_and_visits(spark):
    seeds = spark.createDataFrame([("a", "http://a.jp/#x")], "company string, url string")
    names = {"": 10, "1": 9000, "2": 60, "3": 60, "4": 60, "5": 60}
    sizes = spark.createDataFrame([(f"http://a.jp/{k}", v) for k, v in names.items()], "url string, chars int")
    edges = [
        ("", 0, "http://a.jp/1", "ir"),
        ("", 1, "http://a.jp/2", "news"),
        ("", 2, "http://b.jp/", "news"),
        ("1", 0, "http://a.jp/3", "ir"),
        ("2", 0, "http://a.jp/4#frag", "news"),
        ("2", 1, "http://a.jp/1", "news"),
        ("4", 0, "http://a.jp/5", "about"),
        ("5", 0, "http://a.jp/3", "about"),
    ]
    links = spark.createDataFrame(
        [(f"http://a.jp/{s}", n, t, c) for s, n, t, c in edges], "src string, link_no int, target string, category string"
    )
    got = {(r.url[-1], r.category, r.depth) for r in crawl.expand_frontier(seeds, links, sizes).collect()}
    assert got == {("/", "top", 0), ("1", "ir", 1), ("2", "news", 1), ("4", "news", 2), ("5", "about", 3)}


def test_first_k_and_group_rank(spark):
    rows = [("hot" if i % 3 else "cold", (i * 37) % 300) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long")
    got = {}
    for r in ranking.first_k(df, ["k"], ["seq"], 11).collect():
        got.setdefault(r.k, []).append((r["rank"], r.seq))
    for k, v in got.items():
        assert sorted(v) == list(enumerate(sorted(s for key, s in rows if key == k)[:11], 1))
    for r in ranking.group_rank(df, ["k"], "seq", "pos").collect():
        assert r.pos == sorted(s for key, s in rows if key == r.k).index(r.seq)


def test_first_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS seq")
    plan = ranking.first_k(df, ["k"], ["seq"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("c"), (F.col("id") % 4).alias("y"))
    rows = splits.split_companies(df, "c").collect()
    assert sum(r.is_test for r in rows) == 21 and len({r.c for r in rows}) == 103
    by = splits.split_companies(df, "c", by="y").groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert sorted(r.t for r in by) == [5, 6, 6, 6]
    folds = splits.stratified_folds(df, "c", "y").groupBy("y", "fold").count().collect()
    assert all(r["count"] in (5, 6) for r in folds)


def test_lookup(spark):
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "company_name string")
    cand = spark.createDataFrame(
        [("A", 0, "A x", "1"), ("A", 1, "A", "2"), ("B", 0, "B y", "3"), ("B", 1, "B z", "2"), ("C", 0, "C", None)],
        "query_name string, candidate_no int, name string, number string",
    )
    details = spark.createDataFrame([("2", 0, "https://a"), ("2", 1, "https://b"), ("3", 0, "ERROR")], "number string, detail_no int, url string")
    got = {r.company_name: r.url for r in companies.lookup_urls(names, cand, details).collect()}
    assert got == {"A": "https://a", "B": "NOT_FOUND", "C": "NOT_FOUND", "D": "NOT_FOUND"}


def test_small_label_table_is_broadcast(spark):
    rows = spark.range(50).select(F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("c"))
    labels = ranking.label_ids(rows, "c")
    out = companies.encode_labels(rows.unionByName(spark.createDataFrame([("new",)], "c string")), labels, "c", "y")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.c, r.y) for r in out.collect()} == {("l0", 0), ("l1", 1), ("l2", 2), ("new", None)}


def test_columns_by_name(spark):
    df = spark.createDataFrame([("x", 1, 2.0, 3.0)], "company_name string, has_top int, top_vec_0 double, ir_vec_0 double")
    assert companies.vector_columns(df) == ["top_vec_0", "ir_vec_0"]
    assert companies.vector_columns(df, "ir") == ["ir_vec_0"]
    assert companies.numeric_columns(df) == ["has_top", "top_vec_0", "ir_vec_0"]
    assert companies.present_columns(df, ["ir_vec_0", "none"]) == ["ir_vec_0"]


def test_tfidf_rows_have_unit_length_and_round_trip(spark, tmp_path):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=30)) + " all") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    counts = tfidf.term_counts(df, "id", "t")
    vocab = tfidf.fit_vocabulary(counts, df.agg(F.count("*").alias("n")), "id", max_features=20)
    path = str(tmp_path / "vocab")
    tfidf.save_vocabulary(vocab, path)
    back = tfidf.load_vocabulary(spark, path)
    assert back.terms.count() == 20 and back.terms.filter("term = 'all'").count() == 0
    weights = tfidf.tfidf_weights(counts, back, "id")
    norms = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(x.n == pytest.approx(1) for x in norms)
    dense = tfidf.tfidf_vectors(weights, "id", 20).first()
    assert len(dense.tfidf) == 20


def test_user_tokenizer(spark):
    def make():
        return lambda text: [w for w in text.split(" ") if len(w) > 1]

    df = spark.createDataFrame([(1, "Aa b Cc aa"), (2, None)], "id long, t string")
    tokens = tfidf.tokenizer_udf(make)(F.col("t"))
    got = {(r.term, r.tf) for r in tfidf.term_counts(df, "id", "t", tokens).collect()}
    assert got == {("aa", 2), ("cc", 1)}


def test_fusion_scores_agree_with_numpy(spark):
    w = vectors.seeded_weights(6, 3, 4, embed_size=5, hidden=7)
    r = np.random.default_rng(0)
    x, c = r.normal(size=(20, 6)), r.integers(0, 3, 20)
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(20)], "id long, v array<double>, c int")
    got = {r.id: r.probs for r in vectors.score_pages(df, "v", "c", w).collect()}
    for i in range(20):
        t = np.maximum(w["text_w"] @ x[i] + w["text_b"], 0)
        k = np.maximum(w["cat_w"] @ w["cat_e"][c[i]] + w["cat_b"], 0)
        z = w["out_w"] @ np.concatenate([t, k]) + w["out_b"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i] == pytest.approx(p.tolist())
        assert sum(got[i]) == pytest.approx(1)


def test_company_scores(spark):
    pages = spark.createDataFrame(
        [("a", [0.5, 0.1, 0.1, 0.1, 0.2]), ("a", [0.1, 0.5, 0.1, 0.1, 0.2]), ("b", [0.0, 0.0, 0.0, 0.0, 1.0])],
        "company string, probs array<double>",
    )
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "company string")
    scores = vectors.company_scores(pages, "company", "probs", companies=every)
    got = {r.company: r for r in scores.withColumn("order", F.map_keys("class_probabilities")).collect()}
    assert got["a"].estimated_class == "A" and got["a"].confidence == 0.3 and got["a"].n_pages == 2
    assert got["a"].order == ["S", "A", "B", "C", "D"]
    assert (got["b"].estimated_class, got["b"].estimated_range) == ("S", "2兆円以上")
    assert (got["c"].status, got["c"].estimated_class) == ("no_text", None)
    usable = spark.createDataFrame([("x", "ir"), (" 　", "ir"), ("x", "other")], "t string, c string")
    assert vectors.usable_pages(usable, "t", "c").count() == 1


def test_scaler_pca_and_classifier(spark, tmp_path):
    r = np.random.default_rng(0)
    x = np.hstack([r.normal(3, 2, (90, 3)), np.full((90, 1), 0.1)])
    y = np.arange(90) % 3
    x[:, 0] += 6 * y
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "id long, v array<double>, label int")
    z = np.array([q.v for q in learn.fit_scaler(df, "v").transform(df, "v").orderBy("id").collect()])
    assert np.allclose(z[:, :3], (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)) and np.all(z[:, 3] == 0)
    scores = np.array([q.s for q in learn.project(df, "v", learn.fit_pca(df, "v", 2), "s").orderBy("id").collect()])
    values = np.linalg.svd(x - x.mean(0), compute_uv=False)[:2] ** 2 / 90
    assert np.allclose(scores.var(axis=0), values)
    split = splits.split_companies(df, "id", by="label")
    train, held = split.filter("not is_test"), split.filter("is_test")
    model, best = learn.fit_best(train, held, "v", learn.logistic_grid((0.0, 0.1), 20))
    assert best > 0.8
    path = str(tmp_path / "model")
    learn.save_model(model, path)
    again = learn.classify(held, "v", learn.load_model(path))
    assert metrics.accuracy(again, "label", "pred").first().accuracy == pytest.approx(best)
    mlp, score = learn.fit_best(train, held, "v", [learn.perceptron([4, 6, 3])])
    assert 0 <= score <= 1
    jitter = learn.map_2d(df.select("id", F.slice("v", 1, 1).alias("v")), "v").first()
    assert len(jitter["map"]) == 2


def test_jsonl_readers(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [
        json.dumps({"company_name": "A", "text_content": "x\ny", "page_category": "ir"}),
        "{broken",
        "",
        "{}",
        json.dumps({"company_name": "B", "url": None}, ensure_ascii=False),
    ]
    path.write_text("\n".join(lines), encoding="utf-8")
    rows = readers.read_jsonl_tolerant(spark, str(path)).orderBy("seq").collect()
    assert [(r.company_name, r.text_content, r.url) for r in rows] == [("A", "x\ny", ""), ("", "", ""), ("B", "", "")]
    assert readers.read_jsonl_tolerant(spark, str(path)).count() == 3
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_jsonl_strict(spark, str(path)).collect()


def test_json_documents(spark, tmp_path):
    for name, doc in {"w": {"data": [{"name": "A", "value": 2000000}, {"name": "B", "value": None}]}, "b": [{"name": "A", "value": 5.5}]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc), encoding="utf-8")
    assert [tuple(r) for r in readers.read_ranking(spark, str(tmp_path / "w.json")).collect()] == [("A", 2000000.0), ("B", None)]
    assert [tuple(r) for r in readers.read_ranking(spark, str(tmp_path / "b.json")).collect()] == [("A", 5.5)]
    usable = companies.with_revenue_class(readers.read_ranking(spark, str(tmp_path / "w.json")))
    assert [(r["name"], r.revenue_class) for r in usable.collect()] == [("A", "S")]


def test_csv_keeps_difficult_fields(spark, tmp_path):
    rows = [("A, \"q\"", "C", "ir", ' lead\n"quoted" \\ back\\" 日本 '), ("B", "C", "ir", "plain")]
    df = spark.createDataFrame(rows, "company_name string, revenue_class string, page_category string, text string")
    path = str(tmp_path / "chunks")
    writers.write_chunks_csv(df, path)
    assert sorted(tuple(r) for r in readers.read_chunks_csv(spark, path).collect()) == sorted(rows)


def test_append_new_twice(spark, tmp_path):
    path = str(tmp_path / "features")
    writers.append_new(spark.range(5).toDF("id"), path, "id")
    writers.append_new(spark.range(8).toDF("id"), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def test_streams(spark, tmp_path):
    src, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "company string, probs array<double>"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        pages = jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema, files_per_batch=1)
        jobs.start_scores(pages, "company", "probs", 2, out, marks).awaitTermination()
        return {r.company: (r.n_pages, [round(p, 6) for p in r.probs]) for r in jobs.latest_scores(spark, out, "company").collect()}

    add(("a", [0.2, 0.8]), ("b", [1.0, 0.0]))
    assert run() == {"a": (1, [0.2, 0.8]), "b": (1, [1.0, 0.0])}
    add(("a", [0.6, 0.4]))
    add(("c", [0.5, 0.5]))
    # A new start resumes from the checkpoint: earlier pages count, and count once.
    assert run() == {"a": (2, [0.4, 0.6]), "b": (1, [1.0, 0.0]), "c": (1, [0.5, 0.5])}


def test_incremental_features_take_late_records(spark, tmp_path):
    src, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "id long, t string"

    def step(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        build = lambda b: b.groupBy("id").agg(F.sum(F.length("t")).alias("n"))
        jobs.start_features(stream, "id", build, out, marks).awaitTermination()
        return sorted(tuple(r) for r in jobs.read_features(spark, out, "id").collect())

    assert step((1, "a"), (2, "bb")) == [(1, 1), (2, 2)]
    assert step((2, "more"), (3, "ccc")) == [(1, 1), (2, 6), (3, 3)]


def test_gate_pad_and_softmax(spark):
    row = spark.range(1).select(
        A.pad_to(F.array(F.lit(1), F.lit(2)), 4, 0).alias("p"),
        A.pad_mask(F.array(F.lit(1), F.lit(2)), 4).alias("m"),
        A.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
        A.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("a"),
        A.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        A.gated(F.array(F.lit(2.0)), A.gate_from(F.array(F.lit(0.0)), [[1.0]])).alias("g"),
    ).first()
    assert (row.p, row.m, row.s, row.a, row.u, row.g) == ([1, 2, 0, 0], [1, 1, 0, 0], [0.5, 0.5], 0, [0.6, 0.8], [1.0])
