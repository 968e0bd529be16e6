import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import simhash
from sitegauge.llm.graph import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@given(st.lists(st.sampled_from(["a", "B", "Éa", "\u00a0", "c\x1cd", "long" * 9, " ", "\n", "x\ty"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(words):
    text = " ".join(words)
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_fingerprint_of_many_shingles():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(2500))
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def near_points(rng, centres, each, flips):
    points = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(each):
            y = x
            for b in rng.sample(range(64), rng.randint(0, flips)):
                y ^= 1 << b
            points.add(y)
    return sorted(points)


@pytest.mark.parametrize("centres,each,flips", [(300, 2, 4), (3, 300, 3), (1, 700, 6), (600, 1, 0)])
def test_trees_lose_no_link(centres, each, flips):
    points = near_points(random.Random(centres), centres, each, flips)
    values = np.array(points, dtype=np.uint64)
    assert simhash.linked(values, 2, leaf=16).tolist() == brute_components(points)
    nodes, shards = simhash.fit_tree(values[::3], 20, 2)
    at, to = simhash.route(values, nodes, 2)
    together = [set() for _ in points]
    for a, t in zip(at.tolist(), to.tolist(), strict=True):
        together[a].add(t)
    assert max(to) < shards
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 2:
                assert together[i] & together[j]


def test_near_groups(make_docs):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)) for _ in range(12)]
    pairs = [(i + 10, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 12].split()
        words[rng.randrange(300)] = "other"
        pairs.append((100 + i, " ".join(words)))
    pairs += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "one two"), (None, "no id at all here")]
    rows = simhash.near_groups(make_docs(pairs, fp="f", row="r", root="x"), shard=16).collect()
    prints = [plain_print(t) for _, t in pairs]
    roots = brute_components(prints)
    least = {}
    for (i, _), r in zip(pairs, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((i or -1, f, least.get(r) or -1) for (i, _), f, r in zip(pairs, prints, roots, strict=True))
    assert sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in rows) == want
    kept = simhash.keep_one(make_docs(pairs, near_row="mine"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(least.get(r, -1) for r in set(roots))
    assert kept.columns[-1] == "near_row"
    assert simhash.near_groups(make_docs([])).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_keep_one_of_a_shuffled_frame(spark):
    docs = spark.range(0, 6000, 1, 8).selectExpr("id AS doc_id", "concat('word', id % 150, ' other', id % 150 * 7, ' third', id % 150) AS text").repartition(7)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in simhash.near_groups(docs).collect()})
    assert len({r.text for r in kept}) == len(kept)
