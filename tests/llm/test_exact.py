from collections import Counter

from pyspark.sql import functions as F

from sitegauge.llm import exact

PAIRS = [(1, "a"), (2, "a"), (5, "b"), (3, "a "), (4, None), (6, ""), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000), (None, "a"), (None, "only")]


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, best[t or ""], len(groups[t or ""])) for i, t in pairs)


def test_groups_nulls_ties_long_texts(make_docs):
    docs = make_docs(PAIRS, salt="s", row="r", digest="d", best="b", n="n", rest="q")
    rows = exact.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == brute(PAIRS)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({t or "" for _, t in PAIRS})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_same_digest_different_text(make_docs):
    rows = exact.exact_groups(make_docs(PAIRS), digest=lambda t: F.lit("one").cast("binary")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == brute(PAIRS)
    assert sum(r.kept for r in rows) == len({t or "" for _, t in PAIRS})


def test_keep_one_gives_whole_rows(make_docs):
    docs = make_docs(PAIRS, rest="q", best="b", was_null="w")
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text, r.rest, r.best, r.was_null) for r in kept.collect()]
    assert sorted((i or -1, t or "") for i, t, *_ in rows) == sorted([(2, "a"), (5, "b"), (3, "a "), (6, ""), (8, "x" * 300_000), (-1, "only")])
    assert {r[2:] for r in rows} == {("q", "b", "w")}


def test_hot_text_and_empty_table(make_docs):
    pairs = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    rows = exact.exact_groups(make_docs(pairs, parts=7)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == brute(pairs)
    assert exact.exact_groups(make_docs([])).collect() == []
    assert exact.keep_one(make_docs([])).collect() == []


def test_shuffled_frame(spark):
    docs = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", "concat('t', least(id % 500, 400)) AS text").repartition(7)
    rows = exact.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == brute([(i, f"t{min(i % 500, 400)}") for i in range(20_000)])
    assert sum(r.kept for r in rows) == 401 and all(r.doc_id == r.keep_id for r in rows if r.kept)
    doubled = docs.union(docs).repartition(5)
    assert sum(r.kept for r in exact.exact_groups(doubled).collect()) == 401
    assert sum(r.kept for r in exact.exact_groups(doubled, digest=lambda t: F.lit("one").cast("binary")).collect()) == 401
