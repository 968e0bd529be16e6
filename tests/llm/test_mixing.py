from collections import defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.llm import mixing

WEIGHTS = [5, 2, 1]


def make(spark, rows, parts=4, **more):
    """(doc_id, source, text) rows."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())] + [T.StructField(m, T.StringType()) for m in more])
    return spark.createDataFrame([(*r, *more.values()) for r in rows], schema).repartition(parts)


def words(n, k):
    return " ".join(f"w{k}" for _ in range(n))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def held(rows, sizes, slack):
    taken = defaultdict(int)
    target = brute_targets(sizes)
    for r in rows:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and len(r.shards) == r.copies
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for source, aim in target.items():
        assert abs(taken[source] - aim) <= slack, (source, taken[source], aim)


SOURCES = {"b": 400, "a": 40, None: 25, "": 100, "é": 9, "z": 3}


@pytest.fixture(scope="module")
def rows():
    return [(i * 10 + j, s, words(1 + (i * 7 + j) % 23, i)) for j, (s, n) in enumerate(SOURCES.items()) for i in range(n)]


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    return dict(sizes)


def test_targets_copies_and_shards(spark, rows):
    docs = make(spark, rows, rest="x", nr="n", block="b", size="s", target="t", copies="c")
    plan = mixing.assigned(docs, WEIGHTS, block_words=64, shard_blocks=3).collect()
    assert len(plan) == len(rows)
    held(plan, sizes_of(rows), 23)
    assert len({s for r in plan for s in r.shards}) > 8


def test_reruns_and_layouts_agree(spark, rows):
    take = lambda parts: sorted(
        (r.doc_id, r.copies, tuple(r.shards)) for r in mixing.assigned(make(spark, rows, parts), WEIGHTS, block_words=64, shard_blocks=3).collect()
    )
    assert take(1) == take(7)


def test_the_mix_itself(spark, rows):
    docs = make(spark, rows, shard="old", row="r", copy="c")
    plan = mixing.assigned(docs, WEIGHTS, block_words=64, shard_blocks=3)
    mix = mixing.mixture(docs, plan)
    assert mix.columns == ["doc_id", "source", "text", "row", "copy", "shard"]
    want = sorted((r.doc_id, s) for r in plan.collect() for s in r.shards)
    parts = mix.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, r.shard) for r in parts) == want
    assert len({(r.shard, r.part) for r in parts}) == len({r.shard for r in parts})
    shard = [r.doc_id for r in parts if r.shard == 0]
    assert shard != sorted(shard)


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(None, "a", words(5, 1)), (1, "a", None), (1, "a", ""), (2, None, words(50_000, 2)), (3, "a", words(9, 3)), (3, "a", words(9, 3)), (4, "only empty", "  ")]
    plan = mixing.assigned(make(spark, rows), WEIGHTS).collect()
    assert len(plan) == len(rows)
    held(plan, sizes_of(rows), 50_000)
    assert len({r.copies for r in plan if r.doc_id == 3}) == 1
    assert mixing.assigned(make(spark, []), WEIGHTS).collect() == []
    empty = mixing.assigned(make(spark, [(1, "a", None), (2, "b", "")]), WEIGHTS).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2


def test_hypergeometric_is_exact(spark):
    cases = [(5, 7, 4), (30, 3, 20), (0, 9, 3), (9, 0, 3), (1, 1, 1), (6, 6, 0), (40, 60, 50)]
    for good, bad, draws in cases:
        n = 4000
        grid = spark.range(n).select(
            F.expr(mixing.hypergeometric(f"{good}L", f"{bad}L", f"{draws}L", f"((id + 0.5D) / {n})")).alias("k")
        )
        got = {r.k: r["count"] / n for r in grid.groupBy("k").count().collect()}
        want = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(got) <= set(want)
        assert all(abs(got.get(k, 0) - p) < 2 / n for k, p in want.items())


def test_hypergeometric_of_many(spark):
    drawn = spark.range(400).withColumn("u", mixing.uniform(F.col("id"))).select(F.expr(mixing.hypergeometric("100000000L", "200000000L", "100000000L", "u")).alias("k"))
    mean, std = drawn.agg(F.avg("k"), F.stddev("k")).first()
    p, n = 1 / 3, 10**8
    want = (n * p * (1 - p) * (2 / 3)) ** 0.5
    assert abs(mean - n * p) < 5 * want / 400**0.5 and 0.8 < std / want < 1.2


@pytest.mark.parametrize("quotas, shards", [([7, 0, 30, 1], 5), ([100], 1), ([3, 2], 9), ([50, 70, 900], 40), ([], 3)])
def test_splitting_tree_deals_every_block_once(spark, quotas, shards):
    table = spark.createDataFrame(list(enumerate(quotas)), "nr long, quota long")
    rows = mixing.split_quotas(table, shards, seed=1).collect()
    rooms = defaultdict(int)
    for nr, quota in enumerate(quotas):
        own = sorted((r.first, r.blocks) for r in rows if r.nr == nr and r.blocks)
        ends = [0, *[f + b for f, b in own]]
        assert [f for f, _ in own] == ends[:-1] and ends[-1] == quota
    for r in rows:
        rooms[r.shard] += r.blocks
    if quotas:
        assert len(rooms) == shards and max(rooms.values()) - min(rooms.values()) <= 1


def test_a_third_of_all_in_one_source(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", words(1 + i % 11, i % 5)) for i in range(6000)]
    plan = mixing.assigned(make(spark, rows, 6), WEIGHTS, block_words=128, shard_blocks=4).collect()
    held(plan, sizes_of(rows), 11)
