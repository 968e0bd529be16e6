"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizations tile the same bytes. Every token points to its farthest-right overlapping token (itself where none reaches
further); doubling these pointers for all tokens at once leads each to the last token of its component of overlaps, which
labels the smallest groups of tokens that cover the same bytes. Texts are cut before single spaces where no token of either
vocabulary can reach across; equal units are aligned once and kept, and a batch's new units are aligned side by side.

How many documents link a pair of ids is counted over all documents: each task merges its own counts first. To get the counts
back to the documents, these are dealt in chunks of bounded size, and a chunk is joined only with the pairs that it holds.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sitegauge.llm.bpe import PATTERN, byte_characters, text_batches
from sitegauge.llm.common import extended, without_collector, worker_cache

UNITS = regex.compile(r"(?<=[^ ])(?= \S)")
LOOSE = regex.compile(r" (?:\s|$)")
KEPT = 150_000
KEPT_BYTES = 64
SIDE_BY_SIDE = 1 << 20
CHUNK_PAIRS = 1 << 20
CHUNK_ROWS = 50_000
FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, links binary, chunk long"


def pointers(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token of A, then of B, its farthest-right overlapping token; B before A, and itself, where ends are equal."""
    n = len(ends_a)
    last_b = np.searchsorted(ends_b, ends_a - 1, side="right")
    last_a = np.searchsorted(ends_a, ends_b - 1, side="right")
    beyond = ends_a[last_a] > ends_b if n else np.zeros(0, dtype=bool)
    return np.concatenate([n + last_b, np.where(beyond, last_a, n + np.arange(len(ends_b)))])


def terminals(succ: np.ndarray) -> np.ndarray:
    """Where each pointer leads in the end, by successor doubling."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


class Aligner:
    """Two tokenizers, and the units of text that were aligned lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        as_byte = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if regex.search("[^▁]▁", piece):
                raise ValueError("a piece reaches across a space, texts can't be cut there")
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {raw: i for i, raw in enumerate(self.bytes_a) if self.a.id_to_token(i) not in special}
        # The same vocabulary as ranks: faster, and alike where both know all characters' classes.
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = len(self.bytes_b)
        if len(self.bytes_a) * self.base > 1 << 32:
            raise ValueError("pairs of ids must fit 32 bits")
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])
        self.name_a = [str(i) for i in range(len(self.bytes_a))]
        self.name_b = [str(i) for i in range(len(self.bytes_b))]
        self.lately: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """Parts of a text that starts with a space, cut before single spaces that something visible follows."""
        if LOOSE.search(text):
            return UNITS.split(text)
        return [f" {part}" for part in text[1:].split(" ")]

    def align(self, units: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, n_links, pairs, groups) of each unit, None where the tokens of either do not spell it.

        Every unit starts with a space, which B adds by itself.
        """
        plain = self.ranks.encode_ordinary
        a = [plain(u) if u.isascii() else None for u in units]
        others = [i for i, ids in enumerate(a) if ids is None]
        for i, found in zip(others, self.a.encode_batch([units[i] for i in others], add_special_tokens=False), strict=True):
            a[i] = found.ids
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = list(range(len(units)))
        raw = "".join(units).encode()
        if not raw == b"".join(map(spell_a, chain.from_iterable(a))) == b"".join(map(spell_b, chain.from_iterable(b))):
            good = [i for i, u in enumerate(units) if u.encode() == b"".join(map(spell_a, a[i])) == b"".join(map(spell_b, b[i]))]
        out: list[tuple | None] = [None] * len(units)
        if not good:
            return out
        cut_a = [0, *accumulate(len(a[i]) for i in good)]
        cut_b = [0, *accumulate(len(b[i]) for i in good)]
        ids_a = np.fromiter(chain.from_iterable(a[i] for i in good), dtype=np.int64, count=cut_a[-1])
        ids_b = np.fromiter(chain.from_iterable(b[i] for i in good), dtype=np.int64, count=cut_b[-1])
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        last = terminals(pointers(ends_a, ends_b)) - len(ids_a)
        final = np.flatnonzero(last[len(ids_a) :] == np.arange(len(ids_b)))
        # Where groups end among the tokens of A and of B, and units among the groups.
        of_a = np.searchsorted(final, last[: len(ids_a)])
        group_a = np.searchsorted(of_a, np.arange(len(final)), side="right").tolist()
        group_b = (final + 1).tolist()
        cut_g = np.searchsorted(final, cut_b).tolist()
        first_b = np.searchsorted(ends_b, ends_a - self.length_a[ids_a], side="right")
        last_b = np.searchsorted(ends_b, ends_a - 1, side="right")
        many = last_b - first_b + 1
        cut_l = np.concatenate([[0], np.cumsum(many)])[cut_a].tolist()
        at_b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_b, many)
        pairs = (np.repeat(ids_a, many) * self.base + ids_b[at_b]).astype("<u4").tobytes()
        names_a, names_b = [self.name_a[i] for i in ids_a], [self.name_b[i] for i in ids_b]
        groups, at_a, from_b = [], 0, 0
        for end_a, end_b in zip(group_a, group_b, strict=True):
            left = names_a[at_a] if end_a == at_a + 1 else ",".join(names_a[at_a:end_a])
            right = names_b[from_b] if end_b == from_b + 1 else ",".join(names_b[from_b:end_b])
            groups.append(f"{left}|{right}")
            at_a, from_b = end_a, end_b
        for k, i in enumerate(good):
            out[i] = (
                cut_a[k + 1] - cut_a[k],
                cut_b[k + 1] - cut_b[k],
                cut_g[k + 1] - cut_g[k],
                cut_l[k + 1] - cut_l[k],
                pairs[4 * cut_l[k] : 4 * cut_l[k + 1]],
                ";".join(groups[cut_g[k] : cut_g[k + 1]]),
            )
        return out

    def align_many(self, texts: list[str]) -> list[tuple | None]:
        """As ``align``, for whole texts; None for empty ones too."""
        split = [self.units(f" {text}") if text else [] for text in texts]
        if len(self.lately) > KEPT:
            self.before, self.lately = self.lately, {}
        known: dict[str, tuple | None] = {}
        fresh = []
        for unit in set(chain.from_iterable(split)):
            if unit in self.lately:
                known[unit] = self.lately[unit]
            elif unit in self.before:
                known[unit] = self.lately[unit] = self.before[unit]
            else:
                fresh.append(unit)
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and size < SIDE_BY_SIDE:
                size += len(fresh[end])
                end += 1
            for unit, found in zip(fresh[at:end], self.align(fresh[at:end]), strict=True):
                known[unit] = found
                if len(unit) <= KEPT_BYTES:
                    self.lately[unit] = found
            at = end
        out: list[tuple | None] = []
        for units in split:
            parts = [known[u] for u in units]
            if not parts or None in parts:
                out.append(None)
                continue
            a, b, groups, links, pairs, names = zip(*parts, strict=True)
            out.append((sum(a), sum(b), sum(groups), sum(links), b"".join(pairs), ";".join(names)))
        return out


def pieces(path: str) -> int:
    """How many pieces a sentencepiece model has."""
    return SentencePieceProcessor(model_file=path).get_piece_size()


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``FIELDS``.

    ``groups`` has the ids of both tokenizers in the smallest groups that cover the same bytes, as ``a1,a2|b1;a3|b2,b3``;
    ``pairs`` the linked pairs of ids (id of A times the pieces of B, plus id of B; unsigned, 4 bytes, ascending), ``links`` how
    often each is linked. ``chunk`` numbers runs of rows of bounded size and means nothing else. Whole texts are aligned, with a
    space before. A text that is null, empty or that the tokens of A or of B do not spell has no tokens: zeros and empty
    values. Columns of these names in ``docs`` are replaced.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    docs = docs.drop(*names)
    schema = extended(docs, FIELDS)
    rows = docs.withColumn("_task", F.spark_partition_id())

    def run(batches):
        own = worker_cache(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        number, pairs_in, rows_in = 0, 0, 0
        for batch in batches:
            first = batch["_task"][0].as_py() << 32 if batch.num_rows else 0
            kept = batch.drop_columns(["_task"])
            for at, texts in text_batches(kept, text_col, 2 << 20):
                columns: list[list] = [[] for _ in names]
                for found in own.align_many(texts):
                    a, b, groups, links, pairs, shown = found or (0, 0, 0, 0, b"", "")
                    distinct, often = np.unique(np.frombuffer(pairs, dtype="<u4"), return_counts=True)
                    values = (a, b, groups, links, shown, distinct.tobytes(), often.astype("<u4").tobytes(), first + number)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    pairs_in, rows_in = pairs_in + len(distinct), rows_in + 1
                    if pairs_in >= CHUNK_PAIRS or rows_in >= CHUNK_ROWS:
                        number, pairs_in, rows_in = number + 1, 0, 0
                i64 = pa.int64()
                types = [i64, i64, i64, i64, pa.string(), pa.binary(), pa.binary(), i64]
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.slice(at, len(texts)).columns, *made], names=schema.names)

    return rows.mapInArrow(without_collector(run), schema)


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, pair, docs): how many documents of a chunk link a pair; ``rows`` come from ``aligned``, by way of a table.

    A chunk that is read in several parts gives several rows for a pair.
    """

    def run(batches):
        chunk, pairs, counts, waiting = None, [], [], 0

        def flush():
            distinct, docs = _merged(pairs, counts)
            pairs.clear()
            counts.clear()
            for at in range(0, len(distinct), 1 << 16):
                some = distinct[at : at + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(some), pa.int64()), pa.array(some), pa.array(docs[at : at + (1 << 16)])], names=["chunk", "pair", "docs"]
                )

        for batch in batches:
            for own, raw in zip(batch["chunk"].to_pylist(), batch["pairs"], strict=True):
                if (own != chunk or waiting > 2 * CHUNK_PAIRS) and pairs:
                    yield from flush()
                    waiting = 0
                chunk = own
                found = np.frombuffer(raw.as_py(), dtype="<u4")
                if len(found):
                    pairs.append(found)
                    counts.append(np.ones(len(found)))
                    waiting += len(found)
        if pairs:
            yield from flush()

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk long, pair long, docs long")


def pair_counts(by_chunk: DataFrame, base: int) -> DataFrame:
    """(pair, docs, best): how many documents link a pair, and whether no pair with the same id of A has more."""
    counts = by_chunk.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.floor(F.col("pair") / base))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def weighed(rows: DataFrame, by_chunk: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` of ``aligned`` with ``n_best`` (links of a pair that is best) and ``count_sum`` (of all links' documents)."""
    rows = rows.drop("n_best", "count_sum")
    schema = extended(rows, "n_best long, count_sum long")
    held = by_chunk.select("chunk", "pair").distinct().join(counts, "pair")

    def weigh(docs, known):
        known = known.sort_by("pair")
        pair, number = known["pair"].to_numpy(), known["docs"].to_numpy()
        best = known["best"].combine_chunks().to_numpy(zero_copy_only=False) if known.num_rows else np.zeros(0, dtype=bool)
        n_best, sums = [], []
        for pairs, links in zip(docs["pairs"].to_pylist(), docs["links"].to_pylist(), strict=True):
            at = np.searchsorted(pair, np.frombuffer(pairs, dtype="<u4"))
            often = np.frombuffer(links, dtype="<u4").astype(np.int64)
            n_best.append(int(often[best[at]].sum()) if len(at) else 0)
            sums.append(int((often * number[at]).sum()) if len(at) else 0)
        out = docs.select(schema.names[:-2])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return rows.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(weigh, schema)
