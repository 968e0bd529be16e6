"""Exact token counts of every prefix, by dynamic programming over byte-pair merges.

For a word, ``last[i]`` is the last token of the encoding of its first i bytes: the only token t ending there such that t may
follow ``last[i - len(t)]``, that is, no merge across their border comes before those that built the two. So the count of a
prefix is the count at the start of its last token plus one, for all prefixes together in time linear in the word. A prefix
that ends a word takes a token with the end mark as its last one. Words that begin alike share those steps: new words of a
batch are sorted and take them together, byte by byte, few new ones singly in a tree. Words do not affect one another, so the
counts of a text are running sums, and questions about truncation or budgets are answered from the stored counts.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from itertools import chain, groupby, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm.bpe import byte_characters, text_batches
from sitegauge.llm.common import extended, without_collector, worker_cache

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LETTERS_AND_NUMBERS = regex.compile(r"[\p{L}\p{N}]")
SPACE = regex.compile(r"\s+")
UNEVEN_SPACE = regex.compile(r"[^\S ]\s*| \s+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
END = "</w>"
NEVER = 1 << 60
CACHED = 400_000
CACHED_PIECES = 300_000
CACHED_WORDS = 200_000
CACHED_BEGINNINGS = 600_000
LONGEST_CACHED = 64
FEW_WORDS = 64
WORDS_TOGETHER = 1 << 14
PIECES_TOGETHER = 1 << 18
PAIR_BITS = 21


def doubtful() -> list[str]:
    """Letters and numbers for ``regex`` that ``unicodedata`` does not know: the library may know them or not."""
    known = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    return [c for c in LETTERS_AND_NUMBERS.findall(known) if unicodedata.category(c) == "Cn"]


def strangers(tokenizer: Tokenizer, unknown: list[str]) -> str:
    """Those that the library calls neither letters nor numbers, as ranges: they stay in one word with a hyphen."""
    words = tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(f"-{c}" for c in unknown))
    odd = [ord(unknown[start // 3]) for _, (start, end) in words if end - start == 2]
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Beginnings:
    """A tree of the beginnings of words: of each the last token, the count without an end mark, and the count with one."""

    def __init__(self):
        self.after: dict[int, int] = {}
        self.last, self.count, self.ended, self.tail = [-1], [0], [0], [b""]


class Tails:
    """The tails of words as numbered states, 0 the empty one: ``after`` of each the one that a byte more leads to.

    ``inner`` and ``ending`` are tokens without and with an end mark, each as the token that a state is itself, the state of
    the longest token that ends there, and that of the next shorter one.
    """

    def __init__(self, starts: set[bytes], inner: dict[bytes, int], ending: dict[bytes, int]):
        ordered = sorted(starts, key=len)
        number = {raw: k for k, raw in enumerate(ordered)}
        self.size = np.array(list(map(len, ordered)))
        self.after = np.zeros((len(ordered), 256), np.int32)
        above = np.array([number[raw[:-1]] for raw in ordered])
        byte = np.array([0, *(raw[-1] for raw in ordered[1:])])
        shorter = np.zeros(len(ordered), int)
        tokens = [np.array([kind.get(raw, -1) for raw in ordered]) for kind in (inner, ending)]
        longest = [np.zeros(len(ordered), int) for _ in tokens]
        for size in range(1, len(ordered[-1]) + 1):
            own = np.flatnonzero(self.size == size)
            if size > 1:
                shorter[own] = self.after[shorter[above[own]], byte[own]]
            self.after[above[own], byte[own]] = own
            self.after[own] = self.after[shorter[own]]
            for token, to in zip(tokens, longest, strict=True):
                to[own] = np.where(token[own] >= 0, own, to[shorter[own]])
        self.inner, self.ending = ((token, to, to[shorter]) for token, to in zip(tokens, longest, strict=True))


class PrefixCounter:
    """Counts by a vocabulary of byte-pair merges with word ends, lower case and no white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        vocabulary = whole["model"]["vocab"]
        as_byte = {c: b for b, c in enumerate(byte_characters())}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): vocabulary[a + b] for a, b in pairs}
        self.parts = {merged: pair for pair, merged in self.rank.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        reached = set(vocabulary.values()) - set(self.parts)
        for merged, (a, b) in self.parts.items():  # in the order of ranks
            if a in reached and b in reached and self._may_follow(a, b, merged):
                reached.add(merged)
        self.inner: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            if i in reached and token not in self.special:
                ends = token.endswith(END) and token != END
                raw = bytes(as_byte[c] for c in (token[: -len(END)] if ends else token))
                (self.ending if ends else self.inner)[raw] = i
        self.starts = {raw[:i] for raw in chain(self.inner, self.ending) for i in range(len(raw) + 1)}
        self.tails: dict[bytes, tuple] = {}
        self.states = Tails(self.starts, self.inner, self.ending)
        self.pairs = np.full(1 << PAIR_BITS, -1)
        library, unknown = Tokenizer.from_file(path), doubtful()
        odd = strangers(library, unknown) or "\\x00"
        lower = library.normalizer.normalize_str
        self.lower = {ord(c): low for c in unknown if (low := lower(c)) != c}
        self.unlike = {chr(c) for c in self.lower}
        self.odd = regex.compile(f"[{odd}]")
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[list(map(ord, self.odd.findall("".join(unknown))))] = True
        self.careful = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{odd}]]+|[\p{{N}}--[{odd}]]|[^\s[[\p{{L}}\p{{N}}]--[{odd}]]]+")
        self.totals: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.beginnings = Beginnings()

    def _may_follow(self, left: int, right: int, limit: int = NEVER) -> bool:
        """Whether both stay when they meet: no pair across the border merges before its members go into their own tokens.

        Of equal merges the left one comes first. ``limit`` is the merge that joins the two themselves.
        """
        x, x_goes = left, limit
        while True:
            y, y_goes = right, limit
            while True:
                merged = self.rank.get((x, y), NEVER)
                if merged < x_goes and merged <= y_goes:
                    return False
                if y not in self.parts:
                    break
                y, y_goes = self.parts[y][0], y
            if x not in self.parts:
                return True
            x, x_goes = self.parts[x][1], x

    def _fits(self, left: int, right: int) -> bool:
        key = (left, right)
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > 4 * CACHED:
                self.fits.clear()
            fits = self.fits[key] = self._may_follow(left, right)
        return fits

    def _tail(self, raw: bytes) -> tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]:
        """The longest end of ``raw`` that begins a token, and the tokens, without and with an end mark, that end there, longest first."""
        found = self.tails.get(raw)
        if found is None:
            tail = raw
            while tail not in self.starts:
                tail = tail[1:]
            ends = [tail[i:] for i in range(len(tail))]
            found = tail, *([(len(e), tokens[e]) for e in ends if e in tokens] for tokens in (self.inner, self.ending))
            if len(self.tails) > CACHED_PIECES:
                self.tails.clear()
            self.tails[raw] = found
        return found

    def _step(self, tree: Beginnings, path: list[int], byte: int) -> int:
        """Adds the beginning that is one byte longer than the last one of ``path``."""
        tail, inner, ending = self._tail(tree.tail[path[-1]] + bytes((byte,)))
        last, count, i, fits = tree.last, tree.count, len(path), self.fits.get
        for size, token in ending:
            at = path[i - size]
            if not at or fits((last[at], token)) or self._fits(last[at], token):
                ended = count[at] + 1
                break
        else:
            raise ValueError("a byte has no token")
        for size, token in inner:
            at = path[i - size]
            if not at or fits((last[at], token)) or self._fits(last[at], token):
                break
        else:
            raise ValueError("a byte has no token")
        node = tree.after[path[-1] << 8 | byte] = len(last)
        last.append(token)
        count.append(count[at] + 1)
        tree.ended.append(ended)
        tree.tail.append(tail)
        return node

    def _path(self, raw: bytes) -> list[int]:
        """The counts of the first i bytes of a word, for each i."""
        if len(raw) > LONGEST_CACHED:
            tree = Beginnings()
        else:
            if len(self.beginnings.last) > CACHED_BEGINNINGS:
                self.beginnings = Beginnings()
            tree = self.beginnings
        after, node, path = tree.after, 0, [0]
        for byte in raw:
            node = after.get(node << 8 | byte) or self._step(tree, path, byte)
            path.append(node)
        ended = tree.ended
        return [ended[n] for n in path]

    def _all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` for many pairs. Each pair known has one place in a table, where another may take its turn."""
        key = left << 20 | right
        place = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        known = self.pairs[place]
        fit = known & 1 == 1
        miss = np.flatnonzero(known >> 1 != key)
        if len(miss):
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = np.array([self._fits(k >> 20, k & 0xFFFFF) for k in new.tolist()])
            self.pairs[place[miss[at]]] = new << 1 | found
            fit[miss] = found[back]
        return fit

    def _together(self, words: list[str]) -> np.ndarray:
        """By how much each character of sorted, distinct words changes the count, word after word.

        The nodes of a level are the beginnings of one length; words that share them follow one another.
        """
        raw = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == ord("\n"))
        sizes = np.diff(ends, prepend=-1) - 1
        n, most = len(words), int(sizes.max())
        owner = np.repeat(np.arange(n), sizes)
        raw = raw[raw != ord("\n")]
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.zeros((most, n), np.uint8)
        table[place, owner] = raw
        nodes = np.zeros((most + 1, n), np.int32)
        last, count, ended = (np.zeros(len(raw) + 1, int) for _ in range(3))
        states, alike, made = np.zeros(1, int), np.ones(n, bool), 1
        alike[0], first = False, 0
        for size in range(1, most + 1):
            there, byte = sizes >= size, table[size - 1]
            alike[1:] &= there[:-1] & (byte[1:] == byte[:-1])
            new = there & ~alike
            word = np.flatnonzero(new)
            states = self.states.after[states[nodes[size - 1, word] - first], byte[word]]
            first, made = made, made + len(word)
            nodes[size] = np.cumsum(new) + (first - 1)
            here = slice(first, made)
            ended[here] = count[self._last(self.states.ending, states, nodes, size, word, last)[0]] + 1
            before, last[here] = self._last(self.states.inner, states, nodes, size, word, last)
            count[here] = count[before] + 1
        counts = ended[nodes[place + 1, owner]]
        whole = np.append(raw[1:] & 0xC0 != 0x80, True)  # a word's next byte begins a character, as does the next word's
        counts = counts[whole]
        steps = np.diff(counts, prepend=0)
        lengths = np.fromiter(map(len, words), int, n)
        begins = np.cumsum(lengths) - lengths
        steps[begins] = counts[begins]
        return steps.astype(np.intc)

    def _last(self, kind: tuple, states: np.ndarray, nodes: np.ndarray, size: int, word: np.ndarray, last: np.ndarray):
        """Of the beginnings of one size, each with a word that has it: the node where the last token starts, and that token."""
        tokens, longest, shorter = kind
        before, found = np.zeros(len(word), int), np.zeros(len(word), int)
        left, tail = np.arange(len(word)), longest[states]
        while len(left):
            if not tail.all():
                raise ValueError("a byte has no token")
            at, token = nodes[size - self.states.size[tail], word[left]], tokens[tail]
            fit = at == 0
            met = np.flatnonzero(~fit)
            fit[met] = self._all_fit(last[at[met]], token[met])
            before[left[fit]], found[left[fit]] = at[fit], token[fit]
            left, tail = left[~fit], shorter[tail[~fit]]
        return before, found

    def word(self, word: str) -> int:
        """The count of a whole word."""
        found = self.totals.get(word)
        if found is None:
            raw = word.encode()
            found = 1 if raw in self.ending else self._path(raw)[-1]
            if len(word) <= LONGEST_CACHED:
                if len(self.totals) > CACHED:
                    self.totals.clear()
                self.totals[word] = found
        return found

    def word_prefixes(self, word: str) -> list[int]:
        """The count of each prefix of a word, from one character on."""
        if word in LONG_CONTRACTIONS:  # cut short, these are an apostrophe and a letter
            return [self.word("'"), self.word("'") + self.word(word[1]), self.word(word)]
        raw = word.encode()
        counts = self._path(raw)
        if len(raw) == len(word):
            return counts[1:]
        return [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def _word_steps(self, word: str) -> bytes:
        """By how much each character of a word changes the count, as 32-bit integers."""
        found = self.words.get(word)
        if found is None:
            counts = self.word_prefixes(word)
            found = array("i", map(sub, counts, [0, *counts])).tobytes()
            if len(word) <= LONGEST_CACHED:
                if len(self.words) > CACHED_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def _words(self, plain: str) -> list[str]:
        careful = not plain.isascii() and self.odd.search(plain)
        return (self.careful if careful else WORD).findall(plain)

    def _normal(self, text: str) -> str:
        """As the vocabulary normalizes: composed, white space runs as one space, lower case letter by letter."""
        return self._lower(UNEVEN_SPACE.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text)))

    def _lower(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        low = text.replace("Σ", "σ").lower()
        return low if self.unlike.isdisjoint(low) else low.translate(self.lower)

    def _between_spaces(self, text: str) -> list[str]:
        """The normalized text, split at its spaces."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for Python only
            return self._normal(text).split(" ")
        low = self._lower(text if text.isascii() else unicodedata.normalize("NFC", text))
        return [*([""] if low[:1].isspace() else []), *low.split(), *([""] if low[-1:].isspace() or not low else [])]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(self.unit_counts(text))

    def unit_counts(self, text: str) -> list[int]:
        """Tokens of each unit in turn: a run without white space, or a special string. No token reaches over their borders."""
        if "<|" not in text:
            return self._plain(text)
        return [n for i, p in enumerate(self.cut.split(text)) for n in ([1] if i % 2 else self._plain(p))]

    def _plain(self, text: str) -> list[int]:
        pieces = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        units, get = self.units, self.units.get
        counts = []
        for u in pieces:
            n = get(u)
            if n is None:
                n = sum(map(self.word, self._words(self._normal(u))))
                if len(u) <= LONGEST_CACHED:
                    if len(units) > CACHED:
                        units.clear()
                    units[u] = n
            if u:
                counts.append(n)
        return counts

    def prefixes(self, text: str) -> tuple[str, np.ndarray]:
        """The normalized text, and at i the exact count of its first i characters."""
        if "<|" not in text:
            plain = self._normal(text)
            return plain, self._running(plain.split(" "))
        normal, counts, base = [], [_ZERO], 0
        parts = self.cut.split(text)
        for k in range(0, len(parts), 2):
            plain = self._normal(parts[k])
            special = parts[k + 1] if k + 1 < len(parts) else ""
            # Cut inside a special string, the rest of it is ordinary text next to what stands before.
            own = self._running((plain + special.lower()).split(" "))
            counts.append(base + own[1 : len(plain) + len(special) + (not special)])
            if special:
                base += int(own[len(plain)]) + 1
                counts.append(np.array([base], dtype=np.int32))
            normal += [plain, special]
        return "".join(normal), np.concatenate(counts).astype(np.int32, copy=False)

    def _running(self, pieces: list[str]) -> np.ndarray:
        """The counts of a normalized text, put together from those between its spaces: no token reaches over one."""
        parts = []
        for at in range(0, len(pieces), PIECES_TOGETHER):
            parts += self._pieces(pieces[at : at + PIECES_TOGETHER])
        steps = np.frombuffer(_STAY.join(parts), np.intc)
        out = np.zeros(len(steps) + 1, dtype=np.int32)
        np.cumsum(steps, out=out[1:])
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """``_piece`` of each, new words taken together if they are many."""
        found = list(map(self.pieces.get, pieces))
        missing = [i for i, steps in enumerate(found) if steps is None]
        if not missing:
            return found
        new = {pieces[i] for i in missing}
        made = self._new_pieces([p for p in new if 0 < len(p) <= LONGEST_CACHED]) if len(new) > FEW_WORDS else {}
        known, piece = made.get, self._piece
        for i in missing:
            p = pieces[i]
            found[i] = known(p) or piece(p)
        return found

    def _new_pieces(self, new: list[str]) -> dict[str, bytes]:
        """``_piece`` of those that take no careful pattern, and no cut between words: their new words step together."""
        joined = " ".join(new)
        if not joined.isascii() and self.is_odd[np.frombuffer(joined.encode("utf-32-le"), "<u4")].any():
            new = [p for p in new if not self.odd.search(p)]
            joined = " ".join(new)
        words = WORD.findall(joined)
        steps = {w: self.words.get(w) for w in words}
        steps |= {w: self._word_steps(w) for w in LONG_CONTRACTIONS if w in steps}
        fresh = sorted(w for w, known in steps.items() if known is None)
        if len(self.words) + len(fresh) > CACHED_WORDS:
            self.words.clear()
        for at in range(0, len(fresh), WORDS_TOGETHER):
            some = fresh[at : at + WORDS_TOGETHER]
            made = dict(zip(some, _cut(self._together(some).tobytes(), some), strict=True))
            steps.update(made)
            self.words.update(made)
        flat = b"".join(map(steps.__getitem__, words))
        if len(flat) != len(_STAY) * (len(joined) - joined.count(" ")):
            return {}
        made = dict(zip(new, _cut(flat, new), strict=True))
        if len(self.pieces) + len(made) > CACHED_PIECES:
            self.pieces.clear()
        self.pieces.update(made)
        return made

    def _piece(self, piece: str) -> bytes:
        """By how much each character changes the count."""
        if not piece:
            return b""
        out, at = [], 0
        careful = not piece.isascii() and self.odd.search(piece)
        for m in (self.careful if careful else WORD).finditer(piece):
            out += [_STAY * (m.start() - at), self._word_steps(m[0])]
            at = m.end()
        found = b"".join([*out, _STAY * (len(piece) - at)])
        if len(piece) <= LONGEST_CACHED:
            if len(self.pieces) > CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The counts of every prefix as from ``prefixes``, and those at the ends of units, as from ``unit_counts``, added up."""
        if "<|" in text:
            return self.prefixes(text)[1], np.cumsum([0, *self.unit_counts(text)], dtype=np.int32)
        counts, _, units, _ = self._plain_batch([text])
        return counts, units

    def _plain_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both counts of texts without special strings, text after text, each with how many a text has.

        The texts are counted as one with a space between them, so the place of that space is the start of the next text.
        """
        pieces = list(map(self._between_spaces, texts))
        flat = list(chain.from_iterable(pieces))
        lengths = np.fromiter(map(len, flat), int, len(flat))
        ends = np.cumsum(lengths + 1)
        sizes = np.diff(ends[np.cumsum(list(map(len, pieces))) - 1], prepend=0)
        starts = np.cumsum(sizes) - sizes
        running = self._running(flat)
        marked = np.zeros(len(running), bool)
        marked[ends[lengths > 0] - 1] = True
        marked[starts] = True
        counts = running - np.repeat(running[starts], sizes)
        return counts, sizes, counts[marked], np.add.reduceat(marked, starts, dtype=int)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``both`` gives for each, text after text: the counts of prefixes, how many each text has, those of units, how many."""
        parts = []
        for special, some in groupby(texts, lambda t: "<|" in t):
            if special:
                parts += [(c, [len(c)], u, [len(u)]) for c, u in map(self.both, some)]
            else:
                parts.append(self._plain_batch(list(some)))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _cut(steps: bytes, words: list[str]) -> list[bytes]:
    """The steps of each word out of those of all."""
    ends = np.cumsum(list(map(len, words))) * len(_STAY)
    return [steps[a:b] for a, b in pairwise([0, *ends.tolist()])]


_ZERO = np.zeros(1, dtype=np.int32)
_STAY = np.zeros(1, dtype=np.intc).tobytes()


def counter(path: str) -> PrefixCounter:
    return worker_cache(f"prefixes {path}", lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``n_bytes`` and ``n_tokens`` of the whole text; null counts as empty.

    Special strings within a text are one token each; nothing is added or cut. Columns of these names are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens")

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for at, texts in text_batches(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns,
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([own.count(t) for t in texts], pa.int64()),
                    ],
                    names=[*batch.schema.names, "n_bytes", "n_tokens"],
                )

    return docs.mapInArrow(without_collector(run), extended(docs, "n_bytes long, n_tokens long"))


def all_prefixes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``n_bytes``, ``unit_tokens`` as from ``unit_prefixes`` and ``prefix_tokens`` as from
    ``prefix_counts``, each text read once. Columns of these names are replaced."""
    docs = docs.drop("n_bytes", "unit_tokens", "prefix_tokens")

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for at, texts in text_batches(batch, text_col, 1 << 20):
                found, n_found, units, n_units = own.batch(texts)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(counts, pa.int32()))
                    for counts, sizes in ((units, n_units), (found, n_found))
                ]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(texts)).columns, sizes, *lists],
                    names=[*batch.schema.names, "n_bytes", "unit_tokens", "prefix_tokens"],
                )

    return docs.mapInArrow(without_collector(run), extended(docs, "n_bytes long, unit_tokens array<int>, prefix_tokens array<int>"))


def unit_prefixes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``n_bytes`` and ``unit_tokens``: at i the tokens of the text's first i units.

    Units are runs without white space and special strings. This is the table to store for whole corpora, a few bytes a word:
    the last entry is the count of the whole text, and ``units_within`` says where a budget ends. ``prefix_counts`` has the
    counts between, character by character. A null or blank text has one entry, 0. Columns of these names are replaced.
    """
    docs = docs.drop("n_bytes", "unit_tokens")

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for at, texts in text_batches(batch, text_col):
                counts = [own.unit_counts(t) for t in texts]
                ends = np.cumsum([0, *(len(c) + 1 for c in counts)])
                flat = np.concatenate([part for c in counts for part in (_ZERO, np.cumsum(c, dtype=np.int32))])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns,
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    ],
                    names=[*batch.schema.names, "n_bytes", "unit_tokens"],
                )

    return docs.mapInArrow(without_collector(run), extended(docs, "n_bytes long, unit_tokens array<int>"))


def units_within(budget: int, unit_tokens: str = "unit_tokens") -> Column:
    """How many units of the text fit a budget of tokens."""
    return F.size(F.filter(unit_tokens, lambda n: n <= budget)) - 1


def prefix_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``normalized`` text and ``prefix_tokens``: at i the tokens of its first i characters.

    This is the table to store: ``tokens_within`` and ``longest_within`` answer from it without encoding. A null text counts
    as empty (one count, 0). Columns of these names are replaced.
    """
    docs = docs.drop("normalized", "prefix_tokens")

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for at, texts in text_batches(batch, text_col, 1 << 20):
                found = [own.prefixes(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns,
                        pa.array([n for n, _ in found], pa.string()),
                        pa.array([c for _, c in found], pa.list_(pa.int32())),
                    ],
                    names=[*batch.schema.names, "normalized", "prefix_tokens"],
                )

    return docs.mapInArrow(without_collector(run), extended(docs, "normalized string, prefix_tokens array<int>"))


def tokens_within(characters: int | Column, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first so many characters; of the whole text if it is shorter."""
    at = characters if isinstance(characters, Column) else F.lit(characters)
    return F.get(prefix_tokens, F.least(at, F.size(prefix_tokens) - 1))


def longest_within(budget: int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens (counts may fall where a longer word has fewer tokens)."""
    within = F.transform(F.col(prefix_tokens), lambda n: n <= budget)
    return F.size(prefix_tokens) - F.array_position(F.reverse(within), True)
