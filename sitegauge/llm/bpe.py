"""Byte-pair encoding and decoding with segment trees over the ranks of adjacent pairs.

The leaves of a word's tree are its adjacent pairs, each with (rank, position) or infinity; the root is the leftmost pair
of the lowest rank. A merge changes three leaves, each in a logarithmic number of steps, until the root is infinite. The
words that a batch meets for the first time are merged side by side, one tree per row of an array; words too long for
that get a tree of their own. Text is cut only where the pretokenizer cuts, so the parts of a text encode independently.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import extended, without_collector, worker_cache

PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
UNITS = regex.compile(r"(?= \S)")
LOOSE = regex.compile(r" (?:\s|$)")
NEVER = np.int64(1) << 62
WIDE = 64
CACHED = 150_000
LONGEST_CACHED = 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary whose merged tokens have ids in the order of their ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, chars = whole["model"]["vocab"], byte_characters()
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.first = np.array([vocabulary[c] for c in chars], dtype=np.int64)
        as_byte = {c: b for b, c in enumerate(chars)}
        self.strings = {i: bytes(as_byte[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.strings |= {i: t.encode() for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): vocabulary[a + b] for a, b in pairs}
        merged = list(self.rank.values())
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("the ids of merged tokens must rise with their ranks")
        self.slots = 1 << 18
        self.keys, self.values = np.full(self.slots, -1, dtype=np.int64), np.full(self.slots, NEVER, dtype=np.int64)
        keys = np.array([a << 20 | b for a, b in self.rank], dtype=np.int64)
        values = np.array(merged, dtype=np.int64)
        at = self._slot(keys)
        while len(keys):  # open addressing: of those that want a slot one gets it, the rest move on
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            lost = self.keys[at] != keys
            self.values[at[~lost]] = values[~lost]
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) % self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> 40) & (self.slots - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, NEVER for pairs that don't."""
        keys = left << 20 | right
        at = self._slot(keys)
        out = np.full(len(keys), NEVER, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at]
            same = there == keys[todo]
            out[todo[same]] = self.values[at[same]]
            on = ~same & (there >= 0)
            todo, at = todo[on], (at[on] + 1) % self.slots
        return out


def merge_one(symbols: list[int], rank: dict[tuple[int, int], int]) -> list[int]:
    """The ids of one word, by a segment tree of its own."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    never = int(NEVER)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [never] * (2 * size)
    for i in range(n - 1):
        merged = rank.get((symbols[i], symbols[i + 1]))
        if merged is not None:
            tree[size + i] = merged * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def pair(i: int) -> int:
        j = after[i]
        merged = rank.get((symbols[i], symbols[j])) if j < n else None
        return never if merged is None else merged * size + i

    while tree[1] < never:
        merged, i = divmod(tree[1], size)
        gone = after[i]
        symbols[i], after[i] = merged, after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, never)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merge_many(words: list[bytes], merges: Merges, size: int) -> tuple[bytes, list[int]]:
    """The ids of words of up to ``size`` bytes (a power of two), one segment tree per row: all ids, and where each word's end."""
    count = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    own = np.repeat(np.arange(count), lengths)
    column = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = np.full((count, size + 1), -1, dtype=np.int64)  # the last column stands for no neighbour
    symbols[own, column] = merges.first[joined]
    after = np.tile(np.arange(1, size + 2), (count, 1))
    after[np.arange(size + 1) >= lengths[:, None] - 1] = size
    before = np.tile(np.arange(-1, size), (count, 1))
    before[:, 0] = size
    tree = np.full((count, 2 * size), NEVER, dtype=np.int64)
    row, at = np.nonzero(symbols[:, 1:size] >= 0)
    value = merges.ranks(symbols[row, at], symbols[row, at + 1])
    tree[row, size + at] = np.where(value < NEVER, value * size + at, NEVER)
    level = size
    while level > 1:
        level >>= 1
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = size + at
        tree[rows, node] = values
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pairs(rows: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
        values = np.full(len(rows), NEVER, dtype=np.int64)
        real = np.flatnonzero(right < size)
        found = merges.ranks(symbols[rows[real], at[real]], symbols[rows[real], right[real]])
        values[real] = np.where(found < NEVER, found * size + at[real], NEVER)
        return values

    rows = np.flatnonzero(tree[:, 1] < NEVER)
    while len(rows):
        root = tree[rows, 1]
        at = root & (size - 1)
        gone = after[rows, at]
        right = after[rows, gone]
        symbols[rows, at] = root // size
        symbols[rows, gone] = -1
        after[rows, at] = right
        before[rows, right] = at
        put(rows, gone, np.full(len(rows), NEVER, dtype=np.int64))
        put(rows, at, pairs(rows, at, right))
        left = before[rows, at]
        has = np.flatnonzero(left < size)
        if len(has):
            put(rows[has], left[has], pairs(rows[has], left[has], at[has]))
        rows = rows[tree[rows, 1] < NEVER]
    kept = symbols[:, :size] >= 0
    return symbols[:, :size][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()


class Codec:
    """Encodes and decodes as the vocabulary's library does, special strings within texts included."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        top = max(self.merges.strings) + 1
        self.strings = [self.merges.strings.get(i, b"") for i in range(top)]
        names = sorted(self.merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.mark = names[0][:2] if names else None

    def _units(self, text: str) -> list[str]:
        """Parts that the pretokenizer never joins: a cut before each space that something visible follows."""
        if LOOSE.search(text):
            return [u for u in UNITS.split(text) if u]
        first, *rest = text.split(" ")
        return [first, *[f" {r}" for r in rest]] if first else [f" {r}" for r in rest]

    def _learn(self, units: set[str]) -> None:
        if len(self.words) > CACHED:
            self.words.clear()
        single = {u for u in units if u[1:].isalpha() and (u[0] == " " or u[0].isalpha())}
        cut = {u: PATTERN.findall(u) for u in units - single}
        fresh = set(chain.from_iterable(cut.values()))
        fresh |= single
        fresh -= self.words.keys()
        by_size: dict[int, list[str]] = {}
        for w in fresh:
            n = len(w.encode())
            by_size.setdefault(4 if n <= 4 else 1 << (n - 1).bit_length(), []).append(w)
        for size, some in by_size.items():
            if size > WIDE:
                for w in some:
                    raw = np.frombuffer(w.encode(), dtype=np.uint8)
                    self.words[w] = np.array(merge_one(self.merges.first[raw].tolist(), self.merges.rank), dtype="<u4").tobytes()
                continue
            for at in range(0, len(some), 16384):
                part = some[at : at + 16384]
                ids, ends = merge_many([w.encode() for w in part], self.merges, size)
                begin = 0
                for w, end in zip(part, ends, strict=True):
                    self.words[w] = ids[begin:end]
                    begin = end
        get = self.words.__getitem__
        self.units.update(zip(single, map(get, single), strict=True))
        for u, ws in cut.items():
            self.units[u] = b"".join(map(get, ws)) if len(ws) > 1 else get(ws[0])
        for w in [w for w in fresh if len(w) > LONGEST_CACHED]:
            del self.words[w]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        special = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.merges.special.items()}
        split = []
        for text in texts:
            if self.mark and self.mark in text:
                split.append([p if p in special else self._units(p) for p in self.cut.split(text) if p])
            else:
                split.append([self._units(text)] if text else [])
        met: set[str] = set()
        met.update(*[p for parts in split for p in parts if isinstance(p, list)])
        fresh = met - self.units.keys()
        if len(self.units) + len(fresh) > CACHED:
            self.units.clear()
            fresh = met
        if fresh:
            self._learn(fresh)
        get = self.units.__getitem__
        ids = [b"".join(special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in parts) for parts in split]
        for u in [u for u in fresh if len(u) > LONGEST_CACHED]:  # the caches are bounded in bytes too
            del self.units[u]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return worker_cache(f"codec {path}", lambda: Codec(path))


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` characters, as (offset, texts); nulls become empty."""
    texts = batch[batch.schema.get_field_index(column)]
    at = 0
    while at < batch.num_rows:
        some, size = [], 0
        while at + len(some) < batch.num_rows and size < limit:
            some.append(texts[at + len(some)].as_py() or "")
            size += len(some[-1])
        yield at, some
        at += len(some)


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs``, with ``token_ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    Texts are encoded whole, as the library does with no added special tokens; null counts as empty. Columns of these
    names in ``docs`` are replaced.
    """
    docs = docs.drop("token_ids", "n_tokens")

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            for at, texts in text_batches(batch, text_col):
                ids = own.encode_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(texts)).columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                    names=[*batch.schema.names, "token_ids", "n_tokens"],
                )

    return docs.mapInArrow(without_collector(run), extended(docs, "token_ids binary, n_tokens long"))


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Every row and column of ``encoded``, with the text that the ids stand for; null ids give a null text."""
    encoded = encoded.drop(to)

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            ids = batch[batch.schema.get_field_index(ids_col)]
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < 8 << 20:
                    raw = ids[at + len(some)].as_py()
                    some.append(None if raw is None else own.decode(np.frombuffer(raw, dtype="<u4")))
                    size += len(raw or b"")
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(some)).columns, pa.array(some, pa.string())], names=[*batch.schema.names, to]
                )
                at += len(some)

    return encoded.mapInArrow(run, extended(encoded, f"{to} string"))


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without the text, with ``token_ids``, ``n_tokens`` and the text ``decoded`` from the ids.

    The same as ``encode`` and then ``decode``, in one pass through one worker a task. Null counts as empty. Columns of these
    names in ``docs`` are replaced.
    """
    docs = docs.drop("token_ids", "n_tokens", "decoded")
    others = [c for c in docs.columns if c != text_col]

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            kept = batch.select(others)
            for at, texts in text_batches(batch, text_col):
                ids = own.encode_many(texts)
                back = [own.decode(np.frombuffer(i, dtype="<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept.slice(at, len(texts)).columns,
                        pa.array(ids, pa.binary()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(back, pa.string()),
                    ],
                    names=[*others, "token_ids", "n_tokens", "decoded"],
                )

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    return docs.mapInArrow(without_collector(run), extended(kept, "token_ids binary, n_tokens long, decoded string"))
