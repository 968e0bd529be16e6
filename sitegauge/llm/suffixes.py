"""Benchmark decontamination with suffix arrays over the training texts.

Each task takes its documents in shards of bounded length, without a shuffle. A shard's words become numbers (0 for a word
that no benchmark item has), and a suffix array is built over all suffixes that begin with a benchmark word, sorted to the
depth of a window. Every suffix of every item is then searched in it by bisection: the range of suffixes that share its
window gives all places of that window, and places that follow one another give the longest verbatim match and where it is;
the neighbours of its place give matches shorter than a window. A document is local to a shard, so shards need no merging.
Items come in blocks of bounded size: the driver prepares one at a time, a task has one in memory at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import extended

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII."""
    return raw.translate(WORDS).split()


# --- the items -----------------------------------------------------------------------------------------------------


def prepared(rows: list[tuple[str, bytes]], window: int) -> SimpleNamespace:
    """A block of items: their vocabulary and words as numbers, and where each distinct suffix begins in them.

    Equal suffixes are found with a suffix array of the block, so memory and time stay nearly linear in its words.
    ``windows`` has the words of the window that begins a suffix (0: it begins none), ``items`` the items with that window,
    ``after`` the suffix one word shorter (-1: none).
    """
    rows = sorted(rows)
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)] + [0], dtype=np.int64) for _, raw in rows]
    sizes = np.array([len(n) - 1 for n in numbers], dtype=np.int64)
    bits, words, depth = *_packing(len(vocabulary)), int(sizes.max(initial=0))
    flat = np.concatenate([*numbers, np.zeros(depth + 2 * words + 2, dtype=np.int64)])
    array, _, group = suffix_array(flat, depth, bits, words)
    first = np.flatnonzero(group == np.arange(len(array)))  # the first place of each distinct suffix
    own = np.searchsorted(first, group)  # place in the array -> distinct suffix
    ends = np.cumsum(sizes + 1) - 1
    item = np.searchsorted(ends, array)
    left = ends[item] - array
    # An item shorter than the window is one window itself.
    begun = np.where(left >= window, window, np.where(left == sizes[item], left, 0))
    windows = np.zeros(len(first), dtype=np.int64)
    np.maximum.at(windows, own, begun)
    suffix_at = np.full(len(flat) + 1, -1, dtype=np.int64)
    suffix_at[array] = own
    named = np.flatnonzero(begun)
    order = named[np.lexsort((item[named], own[named]))]
    cuts = np.searchsorted(own[order], np.arange(len(first) + 1))
    names = [sorted({rows[i][0] for i in item[order[a:b]].tolist()}) for a, b in itertools.pairwise(cuts.tolist())]
    return SimpleNamespace(
        vocabulary=vocabulary,
        numbers=flat,
        at=array[first],
        lengths=left[first],
        windows=windows,
        after=suffix_at[array[first] + 1],
        items=names,
    )


def _packing(vocabulary: int) -> tuple[int, int]:
    """Bits of a word number, and how many words go into one key."""
    bits = max(1, int(vocabulary).bit_length())
    return bits, min(62 // bits, 8)


def item_blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about ``block_bytes``, one after the other; an item without an id has an empty name."""
    named = bench.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary")).alias("raw"),
    )
    total = named.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("name", "raw"), F.lit(blocks)) == b).collect()
        yield prepared([(r["name"], bytes(r["raw"])) for r in rows], window)


# --- a shard -------------------------------------------------------------------------------------------------------


def _packed(numbers: np.ndarray, at: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The next words of each position as one number; ``numbers`` ends with zeros enough."""
    key, open_ = np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=np.int64)
    for j in range(words):
        word = numbers[at + j]
        open_ &= word > 0  # nothing beyond a zero can match
        key = (key << bits) | (word * open_)
    return key


def suffix_array(numbers: np.ndarray, depth: int, bits: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of non-zero words in the order of their suffixes, compared up to ``depth`` words or a zero, their first keys,
    and for each the place of the first one that compares equal.

    The first round sorts by one packed key; later rounds double the compared length and touch only positions still tied.
    """
    at = np.flatnonzero(numbers[: len(numbers) - depth - words])
    keys = _packed(numbers, at, bits, words)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    fresh = np.ones(len(array), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    rank = np.zeros(len(numbers), dtype=np.int64)
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(array)), 0))
    rank[array] = group + 1
    done = words
    while done < depth:
        tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        tied = tied[numbers[array[tied] + done - 1] > 0]  # no item reaches beyond a zero
        if not len(tied):
            break
        of, place = array[tied], group[tied]
        beyond = rank[of + done]
        order = np.lexsort((beyond, place))
        array[tied] = of[order]
        place, beyond = place[order], beyond[order]
        differs = np.ones(len(tied), dtype=bool)
        differs[1:] = (place[1:] != place[:-1]) | (beyond[1:] != beyond[:-1])
        fresh[tied] = differs
        group = np.maximum.accumulate(np.where(fresh, np.arange(len(array)), 0))
        rank[array[tied]] = group[tied] + 1
        done *= 2
    return array, keys, group


def _bisect(key_at, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) whose key is not below (right: above) the wanted one, for many searches at once."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        key = key_at(middle)
        before = key <= wanted[open_] if right else key < wanted[open_]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
        open_ = open_[low[open_] < high[open_]]
    return low


def search(numbers: np.ndarray, items: SimpleNamespace) -> tuple[np.ndarray, ...]:
    """Every suffix of every item against the suffix array of a shard.

    Gives (suffix, position, words matched) for the nearest neighbours of each suffix, and the same for every place of a window.
    Neighbours decide matches up to the depth of the array, one window; a longer match is a chain of places of windows.
    """
    bits, words = _packing(len(items.vocabulary))
    size, depth = len(items.at), int(items.windows.max(initial=0)) or int(items.lengths.max(initial=0))
    padded = np.concatenate([numbers, np.zeros(depth + 2 * words + 2, dtype=np.int64)])
    array, first_keys, _ = suffix_array(padded, depth, bits, words)
    count = len(array)
    longest, place = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    windows = [[], []]
    live, low, high = np.arange(size), np.zeros(size, dtype=np.int64), np.full(size, count, dtype=np.int64)
    for level in range(0, depth, words):
        def key_at(i, level=level):
            return first_keys[i] if not level else _packed(padded, array[i] + level, bits, words)

        asked = items.at[live] + level
        wanted = _packed(items.numbers, asked, bits, words)
        left = _bisect(key_at, low, high, wanted, False)
        # The neighbours of the place share most words with the suffix.
        for near in (left - 1, left):
            ok = np.flatnonzero((near >= low) & (near < high))
            query = items.numbers[asked[ok][:, None] + np.arange(words)]
            same = padded[array[near[ok]][:, None] + level + np.arange(words)] == query
            shared = level + np.cumprod(same & (query > 0), axis=1).sum(axis=1)
            better = shared > longest[live[ok]]
            longest[live[ok[better]]], place[live[ok[better]]] = shared[better], array[near[ok[better]]]
        # Windows that end within this level: all suffixes that share the words up to there.
        ends = np.flatnonzero((items.windows[live] > level) & (items.windows[live] <= level + words))
        if len(ends):
            spare = (level + words - items.windows[live[ends]]) * bits
            floor = (wanted[ends] >> spare) << spare
            ceiling = floor | ((np.int64(1) << spare) - 1)
            begin = _bisect(key_at, low[ends], high[ends], floor, False)
            end = _bisect(key_at, low[ends], high[ends], ceiling, True)
            many = end - begin
            windows[0].append(np.repeat(live[ends], many))
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            windows[1].append(array[np.repeat(begin, many) + inside])
        right = _bisect(key_at, left, high, wanted, True)
        on = (left < right) & (items.lengths[live] > level + words)
        live, low, high = live[on], left[on], right[on]
        if not len(live):
            break
    near = np.flatnonzero(longest)
    none = np.zeros(0, dtype=np.int64)
    suffix, position = np.concatenate([none, *windows[0]]), np.concatenate([none, *windows[1]])
    return near, place[near], longest[near], suffix, position, _chained(suffix, position, items)


def _chained(suffix: np.ndarray, position: np.ndarray, items: SimpleNamespace) -> np.ndarray:
    """Words matched from each place of a window on: a window, and one more for each window that follows at the next word."""
    size = len(items.at) + 1
    code = position * size + suffix
    order = np.argsort(code)
    ranked = code[order]
    after = items.after[suffix[order]]
    wanted = (position[order] + 1) * size + after
    follows = np.minimum(np.searchsorted(ranked, wanted), max(len(ranked) - 1, 0))
    last = len(ranked)
    jump = np.append(np.where((after >= 0) & (ranked[follows] == wanted), follows, last), last)
    steps = np.append((jump[:-1] < last).astype(np.int64), 0)
    while (jump[:-1] < last).any():
        steps, jump = steps + steps[jump], jump[jump]
    words = np.empty(last, dtype=np.int64)
    words[order] = steps[:-1]
    return words + items.windows[suffix]


def scanned(texts: list[bytes], blocks) -> list[dict]:
    """For each text: n_words, n_hit, items (sorted), and its longest match (words, first word)."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)  # a zero between documents
    total = int(lengths.sum() + len(lengths))
    marks = np.zeros(total + 1, dtype=np.int64)
    found: list[set[str]] = [set() for _ in texts]
    best = [(0, 0)] * len(texts)
    for items in blocks:
        numbers = np.zeros(total, dtype=np.int64)
        get = items.vocabulary.get
        for words, at in zip(split, starts.tolist(), strict=True):
            numbers[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        if not len(items.at):
            continue
        _, near, shared, suffix, position, matched = search(numbers, items)
        np.add.at(marks, position, 1)
        np.add.at(marks, position + items.windows[suffix], -1)
        doc = np.searchsorted(starts, position, side="right") - 1
        for d, s in np.unique(np.stack([doc, suffix], axis=1), axis=0).tolist():
            found[d].update(items.items[s])
        places, sizes = np.concatenate([near, position]), np.concatenate([shared, matched])
        of = np.searchsorted(starts, places, side="right") - 1
        order = np.lexsort((places, -sizes, of))
        for i in order[np.unique(of[order], return_index=True)[1]].tolist():
            if sizes[i] > best[of[i]][0]:
                best[of[i]] = (int(sizes[i]), int(places[i] - starts[of[i]]))
    hit = np.append(0, np.cumsum(np.cumsum(marks[:-1]) > 0))
    n_hit = hit[starts + lengths] - hit[starts]
    return [
        {"n_words": int(n), "n_hit": int(h), "items": sorted(f), "longest": b}
        for n, h, f, b in zip(lengths, n_hit, found, best, strict=True)
    ]


# --- operators -----------------------------------------------------------------------------------------------------

FOUND = (
    "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
    "longest_match long, longest_at long, contaminated boolean"
)


def benchmark_matches(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Every row and column of ``docs`` with the fields of ``FOUND`` added.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. ``n_hit``
    counts the document's words within places of windows, ``items`` names the items with such windows. ``longest_match`` and
    ``longest_at`` give the words and the first word of the longest match that a suffix search placed in this document (a
    match elsewhere may be as long: of equal ones in a shard, one place is given). Null and wordless texts, and all texts
    if there are no items, match nothing. Items without an id count with an empty name. Items may be long: one of them must
    fit a task's memory, about 100 bytes a word. Fields of ``docs`` that clash with the new ones are replaced.
    """
    new = [f.split()[0] for f in FOUND.split(", ")]
    docs = docs.drop(*[c for c in docs.columns if c in new])
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(b) for b in item_blocks(bench, item_col, item_text_col, window)]

    def blocks():
        """A single block is kept by the worker; of several, one is in its memory at a time."""
        for block in shared:
            path = block._path if len(shared) > 1 else None
            yield block.load_from_path(path) if path else block.value

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch[batch.schema.get_field_index(text_col)]
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < 6 * shard_words:
                    some.append((texts[at + len(some)].as_py() or "").encode())
                    size += len(some[-1])
                rows = scanned(some, blocks())
                items = [r["items"] for r in rows]
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([r["n_words"] for r in rows], pa.int64()),
                        pa.array([r["n_hit"] for r in rows], pa.int64()),
                        pa.array([len(i) for i in items], pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                        pa.array([r["longest"][0] for r in rows], pa.int64()),
                        pa.array([r["longest"][1] for r in rows], pa.int64()),
                        pa.array([r["n_hit"] > 0 for r in rows], pa.bool_()),
                    ],
                    names=[*part.schema.names, *new],
                )
                at += len(some)

    return docs.mapInArrow(run, extended(docs, FOUND))


def remove_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows without any window of an item, with the columns they came with."""
    columns = docs.columns
    found = benchmark_matches(docs, bench, **options)
    return found.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in columns])
