import random

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitegauge.llm import bpe, packing, prefixes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "the", "tion", "É", "ß", "中文", "😀", "'s", "'ll", "'", "12", "½", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "e\u0301", "Σ", "İ", "_", "x" * 80, "ab" * 70, "\x00", "r"]
texts = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


@pytest.fixture(scope="module")
def own_codec():
    return bpe.Codec(BYTES), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def own_counter():
    return prefixes.PrefixCounter(WORDS), Tokenizer.from_file(WORDS)


@given(st.one_of(texts, st.text(max_size=40)))
@settings(max_examples=400, deadline=None)
def test_encoding_is_the_librarys(own_codec, text):
    codec, library = own_codec
    ids = np.frombuffer(codec.encode_many([text])[0], dtype="<u4")
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_both_trees_merge_alike(own_codec):
    codec, rng = own_codec[0], random.Random(2)
    words = [bytes(rng.choice(b"aetinohs") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    ids, ends = bpe.merge_many(words, codec.merges, 64)
    flat = np.frombuffer(ids, dtype="<u4").tolist()
    for word, begin, end in zip(words, [0, *ends], ends, strict=False):
        assert flat[begin // 4 : end // 4] == bpe.merge_one(codec.merges.first[list(word)].tolist(), codec.merges.rank)


@given(st.one_of(texts, st.text(max_size=40)))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_librarys(own_counter, text):
    counter, library = own_counter
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_every_unit(own_counter, text):
    counter, library = own_counter
    running, ends, at = np.cumsum(counter.unit_counts(text)), [], 0
    for i, part in enumerate(counter.cut.split(text)):
        ends += [at + len(part)] if i % 2 else [at + m.end() for m in regex.finditer(r"[^\s\x1c-\x1f]+", part)]
        at += len(part)
    odd = prefixes.ODD_SPACE.search(text)
    assert odd or running.tolist() == [len(library.encode(text[:e], add_special_tokens=False).ids) for e in ends]
    assert (running[-1] if len(running) else 0) == len(library.encode(text, add_special_tokens=False).ids)


def test_long_strings_are_not_kept():
    codec, library, counter = bpe.Codec(BYTES), Tokenizer.from_file(BYTES), prefixes.PrefixCounter(WORDS)
    rng = random.Random(8)
    for _ in range(3):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(4)) + " some words"
        for _ in range(2):
            assert np.frombuffer(codec.encode_many([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            counter.count(text)
    assert sum(map(len, [*codec.units, *codec.words, *counter.units, *counter.totals])) < 200


@given(texts)
@settings(max_examples=60, deadline=None)
def test_every_prefix(own_counter, text):
    counter, library = own_counter
    normal, counts = counter.prefixes(text)
    assert len(counts) == len(normal) + 1
    for i in range(len(counts)):
        assert counts[i] == len(library.encode(normal[:i], add_special_tokens=False).ids)


def test_every_prefix_beside_units(make_docs):
    texts = ["", None, "one  two\nthree-four's <|endoftext|>x", " \u03a3a\x1cb 12 caf\u00e9", "a" * 70 + " b" * 40, "<|end"]
    docs = make_docs(list(enumerate(texts)))
    found = {r.doc_id: r for r in prefixes.all_prefixes(docs, WORDS).collect()}
    units = {r.doc_id: r for r in prefixes.unit_prefixes(docs, WORDS).collect()}
    single = {r.doc_id: r for r in prefixes.prefix_counts(docs, WORDS).collect()}
    library = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        assert found[i].n_bytes == len((t or "").encode()) and found[i].unit_tokens == units[i].unit_tokens
        assert found[i].prefix_tokens == single[i].prefix_tokens and len(found[i].prefix_tokens) == len(single[i].normalized) + 1
        assert found[i].prefix_tokens[-1] == units[i].unit_tokens[-1] == len(library.encode(t or "", add_special_tokens=False).ids)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_prefixes_and_units_from_one_reading(own_counter, text):
    counts, units = own_counter[0].both(text)
    assert counts.tolist() == own_counter[0].prefixes(text)[1].tolist()
    assert units.tolist() == np.cumsum([0, *own_counter[0].unit_counts(text)]).tolist()


def test_words_that_begin_alike_share_their_steps():
    counter, library = prefixes.PrefixCounter(WORDS), Tokenizer.from_file(WORDS)
    for word, steps in (("onorresh", 8), ("onorreshth", 10), ("onorthe", 13), ("onorre", 13)):
        assert counter.word_prefixes(word) == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)]
        assert len(counter.beginnings.last) == 1 + steps
    counter.word_prefixes("ab" * 40)
    assert len(counter.beginnings.last) == 14


def test_many_new_words_step_together():
    """No byte of them is stepped singly, and every prefix has the library's count."""
    counter, library, rng = prefixes.PrefixCounter(WORDS), Tokenizer.from_file(WORDS), random.Random(5)
    parts = ["on", "or", "re", "sh", "the", "ing", "é", "ß", "東", "1", "!?", "\x00", "z"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"a" * 64, "東" * 64, "on", "onor", "onorre"})
    counts, sizes, units, n_units = counter.batch([" ".join(words), ""])
    assert len(counter.beginnings.last) == 1 and sizes.tolist() == [len(" ".join(words)) + 1, 1] and n_units.tolist() == [len(words) + 1, 1]
    at = base = 0
    for word in words:
        assert [n - base for n in counts[at + 1 : at + len(word) + 1]] == [
            len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)
        ]
        at, base = at + len(word) + 1, counts[at + len(word)]
    assert units.tolist() == [0, *np.cumsum([counter.count(w) for w in words]), 0]


@given(st.lists(st.one_of(texts, st.text(max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_batches_give_what_single_texts_give(own_counter, some):
    counter, few = own_counter[0], prefixes.FEW_WORDS
    want = [(counter.prefixes(t)[1], np.cumsum([0, *counter.unit_counts(t)])) for t in some]
    counter.pieces.clear()
    counter.words.clear()
    prefixes.FEW_WORDS = 0
    try:
        counts, sizes, units, n_units = counter.batch(some) if some else [np.zeros(0)] * 4
    finally:
        prefixes.FEW_WORDS = few
    assert counts.tolist() == [int(n) for c, _ in want for n in c] and sizes.tolist() == [len(c) for c, _ in want]
    assert units.tolist() == [int(n) for _, u in want for n in u] and n_units.tolist() == [len(u) for _, u in want]


def test_pairs_that_share_a_place(monkeypatch):
    monkeypatch.setattr(prefixes, "PAIR_BITS", 2)
    counter, rng = prefixes.PrefixCounter(WORDS), random.Random(6)
    words = sorted({"".join(rng.choice("aetinohsé") for _ in range(rng.randint(1, 20))) for _ in range(300)})
    want = [n for w in words for n in np.diff(counter.word_prefixes(w), prepend=0).tolist()]
    assert counter._together(words).tolist() == want and counter._together(words).tolist() == want


def test_operators_on_odd_rows(make_docs):
    pairs = [(1, None), (2, ""), (3, "Hello hello"), (3, "Hello hello"), (None, "a" * 200_000), (5, "one two three four")]
    docs = make_docs(pairs, n_tokens="old", token_ids="old", n_bytes="old", decoded="old")
    rows = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == sorted((i or -1, t or "") for i, t in pairs)
    assert {r.n_tokens for r in rows if not r.text} == {0}
    both = bpe.round_trip(docs, BYTES)
    assert set(both.columns) == {*docs.columns, "token_ids", "n_tokens", "decoded"} - {"text"}
    shown = lambda some: sorted((r.doc_id or -1, bytes(r.token_ids), r.n_tokens, r.decoded) for r in some)
    assert shown(both.collect()) == shown(rows)
    counted = prefixes.token_counts(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in counted)
    assert all(r.n_bytes == len((r.text or "").encode()) for r in counted)
    units = prefixes.unit_prefixes(docs.where("doc_id is not null"), WORDS).select("doc_id", "unit_tokens", prefixes.units_within(2).alias("n"))
    assert sorted(map(tuple, units.distinct().collect())) == [(1, [0], 0), (2, [0], 0), (3, [0, 1, 2], 2), (5, [0, 1, 2, 3, 4], 2)]
    stored = prefixes.prefix_counts(docs.where("doc_id is not null"), WORDS)
    asked = stored.select("doc_id", prefixes.tokens_within(7).alias("n"), prefixes.longest_within(2).alias("c")).distinct().collect()
    assert sorted(map(tuple, asked)) == [(1, 0, 0), (2, 0, 0), (3, 2, 11), (5, 2, 8)]
    for operator in (bpe.encode, bpe.round_trip, prefixes.token_counts, prefixes.unit_prefixes, prefixes.prefix_counts):
        assert operator(make_docs([]), BYTES if operator in (bpe.encode, bpe.round_trip) else WORDS).collect() == []


@given(st.lists(st.integers(0, 40), max_size=40), st.integers(1, 16))
@settings(max_examples=300, deadline=None)
def test_packing_is_best_fit_decreasing_and_loses_nothing(lengths, size):
    rows = packing.pack(lengths, size)
    assert sorted((d, at + k) for r in rows for d, at, n in r for k in range(n)) == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    assert all(sum(n for _, _, n in r) <= size for r in rows)
    rooms = []
    for n in sorted((n % size for n in lengths if n % size), reverse=True):
        fit = [r for r in rooms if r >= n]
        rooms.append((min(fit) if fit else size) - n)
        if fit:
            rooms.remove(min(fit))
    assert sorted(size - sum(n for _, _, n in r) for r in rows) == sorted(rooms + [0] * sum(n // size for n in lengths))


def test_packed_rows_give_the_ids_back(make_docs, spark, tmp_path):
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 90)))) for i in range(80)] + [(200, None), (None, "no id")]
    encoded = bpe.encode(make_docs(pairs, block="b", row="r"), BYTES)
    packing.write_packed(packing.packed(encoded, 32, pad=50256, block_tokens=500), str(tmp_path / "packed"))
    want = {r.doc_id: np.frombuffer(r.token_ids, dtype="<u4").tolist() for r in encoded.collect() if r.token_ids}
    got = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, places = np.frombuffer(r.ids, dtype="<u4"), np.frombuffer(r.positions, dtype="<u4")
        assert len(ids) == len(places) == 32 and (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in got.items()} == want
    assert packing.packed(bpe.encode(make_docs([]), BYTES), 32, pad=0).collect() == []


def test_counts_over_all_planes(own_counter):
    """Code points that are unassigned or new in some Unicode version included."""
    counter, library = own_counter
    rng, new = random.Random(3), prefixes.doubtful()
    plane = lambda: chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)]))
    some = ["".join(rng.choice((plane(), rng.choice(new), rng.choice("aB1 -'é東İ"))) for _ in range(rng.randint(1, 8))) for _ in range(8000)]
    some += ["İ\U0003ec50", "İ\U00018e63", "Ɤ", "aꟜb"]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert [counter.count(t) for t in some] == want


@pytest.fixture(scope="module")
def rank_encoder():
    return packing.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), BYTES, public_tokenizers.PATTERN)


@given(st.lists(st.one_of(texts, st.text(max_size=40)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_rank_encoder_gives_the_librarys_ids(rank_encoder, own_codec, some):
    library = own_codec[1]
    got = [np.frombuffer(packing.ids_of(rank_encoder, t), dtype="<u4").tolist() for t in some]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_rank_encoder_on_long_texts(rank_encoder, own_codec):
    some = ["x" * 300_000, " " * 20_000, "\n" * 20_000, "QUJD" * 20_000, "東" * 20_000, "word " * 50_000, "a" * 4095 + " " + "b" * 5000, ""]
    assert [packing.ids_of(rank_encoder, t) for t in some] == own_codec[0].encode_many(some)
