import hashlib
import random

import pytest

from sitegauge.llm import suffixes


def brute(text, items, window):
    words, hit, names = suffixes.words_of((text or "").encode()), set(), set()
    for name, item in items:
        w = suffixes.words_of((item or "").encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit.update(range(p, p + n))
                    names.add("" if name is None else str(name))
    names = sorted(names)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def longest(text, items):
    words = suffixes.words_of((text or "").encode())
    best = 0
    for _, item in items:
        w = suffixes.words_of((item or "").encode())
        for i in range(len(w)):
            for p in range(len(words)):
                n = 0
                while i + n < len(w) and p + n < len(words) and w[i + n] == words[p + n]:
                    n += 1
                best = max(best, n)
    return best


@pytest.mark.parametrize("window,vocabulary", [(3, 3), (10, 2), (4, 30), (10, 500)])
def test_against_brute_force(spark, make_docs, window, vocabulary):
    rng = random.Random(window * vocabulary)
    some = lambda n: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    items = [(i, some(rng.randint(0, 25))) for i in range(12)] + [(90, items_text := some(20)), (91, items_text), (None, "lost name"), (92, None), (93, "É1 Ünï")]
    pairs = [(i, some(rng.randint(0, 60))) for i in range(25)]
    pairs += [(50 + i, f"Oov {some(4)}. {items[i % 12][1].upper()}; {some(3)}") for i in range(12)]
    pairs += [(70, None), (71, ""), (72, "..."), (73, "LOST, name"), (74, "é1 ünï É1--Ünï"), (75, f"{items_text} {items_text}"), (75, items_text), (None, items_text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = suffixes.benchmark_matches(make_docs(pairs, n_hit="old", items="old"), bench, window=window, shard_words=40).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == sorted((i or -1, *brute(t, items, window)) for i, t in pairs)
    for r in rows:
        if r.doc_id is not None and 0 <= r.doc_id < 50:
            assert r.longest_match <= longest(r.text, items)
            if r.n_hit and longest(r.text, items) >= window:
                assert r.longest_match == longest(r.text, items)


def test_longest_match_and_place(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    row = suffixes.benchmark_matches(make_docs([(1, "x y b c d e f g q a b")], parts=1), bench).first()
    assert (row.longest_match, row.longest_at, row.contaminated) == (6, 2, False)


def test_a_very_long_item():
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    item = some(100_000)
    long_run = ["same"] * 3000
    docs = [some(50) + item[20_000:95_000] + some(9), some(500), item[5:14], item[5:15], some(4) + long_run[:2000]]
    block = suffixes.prepared([("long", " ".join(item).encode()), ("run", " ".join(long_run).encode())], 10)
    assert max(a.nbytes for a in vars(block).values() if hasattr(a, "nbytes")) < 3_000_000
    rows = suffixes.scanned([" ".join(d).encode() for d in docs], [block])
    assert [r["n_hit"] for r in rows] == [75_000, 0, 0, 10, 2000]
    assert [r["items"] for r in rows] == [["long"], [], [], ["long"], ["run"]]
    assert [r["longest"] for r in rows[:1] + rows[3:]] == [(75_000, 50), (10, 0), (2000, 4)]


def test_several_blocks_in_a_job(spark, make_docs, monkeypatch):
    plain = suffixes.item_blocks
    monkeypatch.setattr(suffixes, "item_blocks", lambda *a: plain(*a, block_bytes=40))
    bench = spark.createDataFrame([(i, f"k{i} l{i} m{i}") for i in range(12)], "item_id long, text string")
    rows = suffixes.benchmark_matches(make_docs([(i, f"zero k{i} l{i} m{i} k{i + 1} l{i + 1}") for i in range(12)]), bench).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in rows) == [(i, 3, [str(i)]) for i in range(12)]


def test_removal_and_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = make_docs([(1, "zero one two three"), (2, "one two"), (3, None)], contaminated="c", n_words="n")
    assert sorted(r.doc_id for r in suffixes.remove_contaminated(docs, bench).collect()) == [2, 3]
    assert suffixes.remove_contaminated(docs, bench).columns == [c for c in docs.columns]
    assert suffixes.remove_contaminated(docs, bench.limit(0)).count() == 3
    assert suffixes.benchmark_matches(make_docs([]), bench).collect() == []


def test_items_in_several_blocks(spark, make_docs):
    bench = spark.createDataFrame([(i, f"k{i} l{i} m{i}") for i in range(9)], "item_id long, text string")
    blocks = list(suffixes.item_blocks(bench, "item_id", "text", 10, block_bytes=20))
    assert len(blocks) > 3
    text = b"k1 l1 m1 k8 l8 m8 k2 l2"
    assert suffixes.scanned([text], blocks)[0]["items"] == ["1", "8"]
    assert suffixes.scanned([text], blocks)[0]["n_hit"] == 6
