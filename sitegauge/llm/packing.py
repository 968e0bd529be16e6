"""Packing token ids into rows of fixed length, best fit decreasing.

Documents longer than a row are split into full rows and a rest. Pieces go, longest first, each into the open row with the
least room that still holds it; a segment tree over the room left (0 to the row length) finds it in logarithmic steps. Tasks
pack blocks of bounded size by themselves: packing needs no shuffle, and only the last row of a block is poorly filled.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.bpe import text_batches
from sitegauge.llm.common import extended, without_collector, worker_cache

BLOCK_TOKENS = 4 << 20
PACKED = (
    "block long, row int, doc_ids array<{id}>, piece_starts array<long>, cu_seqlens array<int>, n_tokens int, "
    "ids binary, positions binary"
)


class Rooms:
    """Open rows by the room they have left: a segment tree whose nodes tell whether any row below has that room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _set(self, room: int, value: bool) -> None:
        node = self.size + room
        while node and self.any[node] != value:
            self.any[node] = value
            node >>= 1
            value = node and (self.any[2 * node] or self.any[2 * node + 1])

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._set(room, True)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least ``least``; it is no longer open."""
        node = self.size + least
        while not self.any[node]:
            while node & 1:  # a right child: go up to where there is something further right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not self.any[2 * node])
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, False)
        return room, row


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, first token, tokens). Empty documents take no room and are in no row."""
    rows, rests = [], []
    for doc, n in enumerate(lengths):
        rows += [[(doc, at, size)] for at in range(0, n - size + 1, size)]
        if n % size:
            rests.append((doc, n - n % size, n % size))
    rooms = Rooms(size)
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        found = rooms.take(piece[2])
        if found is None:
            rows.append([])
            found = size, len(rows) - 1
        room, row = found
        rows[row].append(piece)
        if room > piece[2]:
            rooms.add(room - piece[2], row)
    return rows


def rank_encoder(ranks: str, vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """An encoder from a vocabulary's table of ranks; its special strings are those of the other form of it."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(vocabulary, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)


def ids_of(own: tiktoken.Encoding, text: str) -> bytes:
    """The ids of a whole text, as little-endian unsigned 32-bit integers; special strings within it are their ids."""
    return own.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def encoded(docs: DataFrame, ranks: str, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``token_ids`` (little-endian unsigned 32-bit integers) of every row, as ``bpe.encode`` gives them.

    ``ranks`` and ``vocabulary`` are two forms of one vocabulary, ``pattern`` splits its words. Null texts count as empty.
    """
    docs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    schema = extended(docs.drop("_text"), "token_ids binary")

    def run(batches):
        own = worker_cache(f"ranks {ranks}", lambda: rank_encoder(ranks, vocabulary, pattern))
        for batch in batches:
            for at, texts in text_batches(batch, "_text"):
                ids = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([ids_of(own, t) for t in texts], pa.binary())], names=schema.names)

    return docs.mapInArrow(without_collector(run), schema)


def packed(encoded: DataFrame, size: int, pad: int, id_col: str = "doc_id", ids_col: str = "token_ids", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of a packed matrix (``PACKED``), from ids as little-endian unsigned 32-bit integers.

    ``ids`` has ``size`` ids, ``pad`` beyond ``n_tokens``; ``cu_seqlens`` the running lengths of its pieces from 0 on;
    ``positions`` the place of each id in its piece, starting anew at 0 with each (and with the padding); ``doc_ids`` and
    ``piece_starts`` tell where each piece comes from, so that documents can be put together again. Null or empty ids take
    no room. Which documents share a row depends on how the input is split.
    """
    id_type = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.spark_partition_id().cast("long").alias("part"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("raw"))

    def matrix(number: int, docs: list, texts: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for r, pieces in enumerate(pack([len(t) for t in texts], size)):
            ends = np.cumsum([0, *[n for _, _, n in pieces]])
            ids, places = np.full(size, pad, dtype="<u4"), np.zeros(size, dtype="<u4")
            for (doc, at, n), begin in zip(pieces, ends, strict=False):
                ids[begin : begin + n] = texts[doc][at : at + n]
                places[begin : begin + n] = np.arange(n)
            places[ends[-1] :] = np.arange(size - ends[-1])
            values = (number, r, [docs[d] for d, _, _ in pieces], [a for _, a, _ in pieces], ends.tolist(), int(ends[-1]), ids.tobytes(), places.tobytes())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches):
        docs, texts, total, number, schema = [], [], 0, None, None
        for batch in batches:
            if schema is None:
                names = [f.split()[0] for f in PACKED.split(", ")]
                i64, i32 = pa.int64(), pa.int32()
                types = [i64, i32, pa.list_(batch["doc_id"].type), pa.list_(i64), pa.list_(i32), i32, pa.binary(), pa.binary()]
                schema = pa.schema(list(zip(names, types, strict=True)))
            for part, doc, raw in zip(batch["part"], batch["doc_id"], batch["raw"], strict=True):
                number = part.as_py() << 32 if number is None else number
                docs.append(doc.as_py())
                texts.append(np.frombuffer(raw.as_py() or b"", dtype="<u4"))
                total += len(texts[-1])
                if total >= block_tokens:
                    yield matrix(number, docs, texts, schema)
                    docs, texts, total, number = [], [], 0, number + 1
        if docs:
            yield matrix(number, docs, texts, schema)

    return rows.mapInArrow(without_collector(run), PACKED.format(id=id_type))


def write_packed(rows: DataFrame, path: str) -> None:
    """Write the matrix as Parquet, a file per task; ids and positions are fixed-length binary rows."""
    rows.write.parquet(path)
