import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf the siblings' digests up to it."""
    proofs, at, nodes = ["" for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            proofs[k] += "".join(run[: i % 8] + run[i % 8 + 1 :])
        nodes, at = [h("".join(r)) for r in runs], [i // 8 for i in at]
    return nodes[0], proofs


def brute(rows):
    """(id, leaf, subroot, root, proof) for (id, group, leaf) rows."""
    groups = {}
    for i, g, d in rows:
        groups.setdefault(g, []).append((i is not None, i, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort()
        subs[g] = tree([d for *_, d in groups[g]])
    root, tops = tree([subs[g][0] for g in names])
    return Counter(
        (i, d, subs[g][0], root, p + tops[k]) for k, g in enumerate(names) for (_, i, d), p in zip(groups[g], subs[g][1], strict=True)
    )


def manifest(spark, rows, parts=5, **more):
    made = spark.createDataFrame([(i, g, bytes.fromhex(d), *more.values()) for i, g, d in rows], f"id long, grp string, leaf binary{''.join(f', {m} string' for m in more)}")
    return merkle.manifest(made.repartition(parts), "grp", "id")


def shown(sealed):
    rows = sealed.select("id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "witness")]).collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 9, "": 8, "b": 1}, {"x": 513, "y": 512, "z": 64}, {"hot": 4200, "é": 3}])
def test_manifest_against_brute_force(spark, sizes):
    rows = [(3 * i + (0 if i % 7 else 10**12), g, h(f"{g} {i}")) for g, n in sizes.items() for i in range(n)]
    assert shown(manifest(spark, rows)) == brute(rows)


def test_many_groups(spark):
    rows = [(i, f"g{i % 70}", h(str(i))) for i in range(200)]
    assert shown(manifest(spark, rows)) == brute(rows)


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "a", h("1")), (None, "a", h("0")), (5, None, h("x")), (5, None, h("x")), (5, None, h("w"))] + [(7, "a", h("same"))] * 20
    more = {"pos": "p", "n": "n", "root": "r", "digest": "d", "block": "b", "kept": "k", "witness": "w", "grp2": "g"}
    sealed = manifest(spark, rows, **more)
    assert shown(sealed) == brute(rows)
    assert {tuple(r) for r in sealed.select("digest", "block", "kept", "grp2").collect()} == {("d", "b", "k", "g")}


def test_empty_table_and_null_leaf(spark):
    none = spark.createDataFrame([], "id long, grp string, leaf binary")
    assert merkle.manifest(none, "grp", "id").collect() == []
    row = merkle.manifest(spark.createDataFrame([(1, "a", None)], "id long, grp string, leaf binary"), "grp", "id").first()
    assert row.root.hex() == h("") and row.leaf is None and row.witness == b""


def test_leaf_frames_values_and_tampering_shows(spark, make_docs):
    texts = ["", None, "Ä" * 3, "x" * 200_000, "1:a", "A"]
    docs = make_docs(list(enumerate(texts)))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = docs.select(*columns, merkle.leaf(*[F.col(c) for c in columns]).alias("leaf"))
    for r in leaves.collect():
        values = [None if r[c] is None else str(r[c]) for c in columns]
        assert r.leaf.hex() == h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))
    sealed = merkle.manifest(leaves, "lang", "doc_id").withColumn("seen", F.when(F.col("doc_id") == 5, F.unhex(F.sha2(F.lit("other"), 256))).otherwise(F.col("leaf")))
    folded = merkle.with_folded_root(sealed, "seen").collect()
    assert {r.doc_id: r.folded_root == r.root for r in folded} == {i: i != 5 for i in range(6)}
