"""Merkle manifests of a data set, built by appending, with a witness for every row.

Leaves come in order of their group; every run of ``FAN`` nodes becomes the digest of their hexadecimal digests, level by
level, until a group has one node, its subroot; the subroots, in order of their groups, are leaves of the tree above. A task
appends the leaves of one aligned block of ``BLOCK`` positions to its open subtrees: a leaf's witness starts empty, and each
time a subtree is completed by its last sibling, every leaf below gets the siblings of the child that holds it. The roots
of the blocks are appended in the same way one stage further up, which extends the witnesses of all their leaves, until
one node is left. No task holds more than a block, however many rows a group has.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import extended, map_batches, materialised
from sitegauge.operators.ranking import row_positions

FAN = 8
HEIGHT = 3
BLOCK = FAN**HEIGHT


def digest(nodes: bytes) -> bytes:
    """SHA-256 of digests, taken as lower-case hexadecimal text."""
    return hashlib.sha256(nodes.hex().encode()).digest()


def leaf(*columns: Column) -> Column:
    """SHA-256 (binary) of the values, each as byte count, ``:`` and text in UTF-8; null as ``-``."""
    texts = [c.cast("string") for c in columns]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


class OpenSubtrees:
    """Nodes appended one by one below one root of ``HEIGHT`` levels; ``count`` nodes are in the whole group."""

    def __init__(self, count: int):
        self.count = count
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(HEIGHT + 1)]
        self.witnesses: list[bytes] = []

    def append(self, node: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(b"")
        self._rise(0, (node, at, at + 1))

    def _rise(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if level < HEIGHT and len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            siblings = b"".join(digests[:i] + digests[i + 1 :])
            for at in range(first, end):
                self.witnesses[at] += siblings
        self._rise(level + 1, (digest(b"".join(digests)), run[0][1], run[-1][2]))

    def close(self) -> bytes:
        """The root, after the last node: shorter runs are completed as long as their level has further nodes."""
        nodes = self.count
        for level in range(HEIGHT):
            if nodes == 1:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            nodes = -(-nodes // FAN)
        return self.open[HEIGHT][0][0]


def _appended(nodes: pa.Table) -> tuple[OpenSubtrees, pa.Table]:
    """The subtrees after all nodes of a block, and the nodes in order."""
    nodes = nodes.sort_by("pos")
    tree = OpenSubtrees(nodes["n"][0].as_py())
    for node in nodes["digest"].to_pylist():
        tree.append(node)
    return tree, nodes


def _block_roots(nodes: DataFrame) -> DataFrame:
    """(grp, pos, n, digest) of the blocks, the nodes of the next stage up; ``nodes`` has these columns too."""
    kind = nodes.schema["grp"].dataType.simpleString()

    def close(key, table):
        tree, table = _appended(table)
        n = -(-tree.count // BLOCK)
        return pa.table({"grp": table["grp"].slice(0, 1), "pos": [key[1].as_py()], "n": [n], "digest": pa.array([tree.close()], pa.binary())})

    blocks = nodes.select("grp", "pos", "n", "digest", F.floor(F.col("pos") / BLOCK).alias("block"))
    return blocks.groupBy("grp", "block").applyInArrow(close, f"grp {kind}, pos long, n long, digest binary")


def _extended_witnesses(nodes: DataFrame, above: DataFrame, carried: str) -> DataFrame:
    """``nodes`` with their witness in their block and on to the root, and with the columns that the block's row above carries."""
    names = [f.split()[0] for f in carried.split(", ")]
    fields = extended(nodes, f"witness binary, {carried}")

    def attach(table, parents):
        tree, table = _appended(table)
        tree.close()
        rest = parents["witness"][0].as_py()
        out = table.select(fields.names[: -1 - len(names)])
        out = out.append_column("witness", pa.array([w + rest for w in tree.witnesses], pa.binary()))
        for name in names:
            out = out.append_column(name, pa.array([parents[name][0].as_py()] * out.num_rows, parents.schema.field(name).type))
        return out

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    parents = above.select("grp", F.col("pos").alias("block"), "witness", *names)
    return blocks.groupBy("grp", "block").cogroup(parents.groupBy("grp", "block")).applyInArrow(attach, fields)


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the stages above them, up to one node for each group."""
    stages = [nodes]
    while True:
        stages.append(materialised(_block_roots(stages[-1]), "merkle-blocks"))
        if (stages[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return stages


NEW = ("pos", "n", "group_pos", "n_groups", "witness", "subroot", "root")


def manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str = "leaf") -> DataFrame:
    """Every row and column of ``rows`` with pos, n, group_pos, n_groups, witness, subroot and root.

    ``pos`` of ``n`` is the row's place in its group, ``group_pos`` of ``n_groups`` the group's; ``witness`` has the digests
    of all siblings (32 bytes each) from the leaf's level up to the root, each run from left to right. Groups and rows
    ascend, null first; rows equal in order go by their leaf, and those equal in both may swap places, which changes
    nothing. A null leaf counts as the digest of nothing. Columns of these names in ``rows`` are replaced; no rows give none.
    ``rows`` is read more than once: give a table, not a costly expression.
    """
    own = [c for c in rows.columns if c not in NEW]
    nodes = rows.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("kept"),
        F.col(f"`{group_col}`").alias("grp"),
        F.col(f"`{order_col}`").alias("ord"),
        F.coalesce(F.col(f"`{leaf_col}`"), F.unhex(F.sha2(F.lit(""), 256))).alias("digest"),
    )
    *below, groups = _stages(row_positions(nodes, ["grp"], ["ord", "digest"], "pos", total="n").drop("ord"))
    # The subroots are the leaves of the tree above.
    tops = row_positions(groups.select(F.col("grp").alias("name"), "digest"), [], ["name"], "pos", total="n")
    *above, root = _stages(tops.withColumn("grp", F.lit(0)))
    at = root.select("grp", "pos", F.unhex(F.lit("")).alias("witness"), F.col("digest").alias("root"))
    for stage in reversed(above):
        at = _extended_witnesses(stage, at, "root binary")
    at = at.select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot"),
        "root", F.col("pos").alias("group_pos"), F.col("n").alias("n_groups"),
    )
    for stage in reversed(below):
        at = _extended_witnesses(stage, at, "subroot binary, root binary, group_pos long, n_groups long")
    return at.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(own)], *NEW)


def fold(node: bytes, witness: bytes, *places: tuple[int, int]) -> bytes:
    """The root that follows from a leaf and its siblings; ``places`` has (position, nodes) in its group and of its group."""
    at = 0
    for pos, n in places:
        while n > 1:
            index, siblings = pos % FAN, min(FAN, n - pos // FAN * FAN) - 1
            run, at = witness[at : at + 32 * siblings], at + 32 * siblings
            node = digest(run[: 32 * index] + node + run[32 * index :])
            pos, n = pos // FAN, -(-n // FAN)
    return node


def with_folded_root(rows: DataFrame, leaf_col: str) -> DataFrame:
    """Rows of a manifest with ``folded_root``, recomputed from the leaf in ``leaf_col`` and the witness alone."""
    nothing = hashlib.sha256(b"").digest()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = {name: batch[name].to_pylist() for name in ("pos", "n", "group_pos", "n_groups", "witness", leaf_col)}
        roots = [
            fold(node or nothing, witness, (pos, n), (group, groups))
            for node, witness, pos, n, group, groups in zip(at[leaf_col], at["witness"], at["pos"], at["n"], at["group_pos"], at["n_groups"], strict=True)
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "folded_root"])

    rows = rows.drop("folded_root")
    return map_batches(rows, extended(rows, "folded_root binary"), each)
