import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def tokens(aligner, text):
    """Ids of both libraries for the whole text with their byte ranges; None where they don't spell it."""
    if not text:
        return None
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text, num_threads=1)
    raw = (" " + text).encode()
    out = []
    for ids, spell in ((a, aligner.bytes_a), (b, aligner.bytes_b)):
        if b"".join(spell[i] for i in ids) != raw:
            return None
        ends = np.cumsum([len(spell[i]) for i in ids]).tolist()
        out.append(list(zip(ids, [0, *ends], ends, strict=False)))
    return out


def brute(aligner, text):
    """(n_a, n_b, groups, links as a Counter)."""
    both = tokens(aligner, text)
    if both is None:
        return 0, 0, "", Counter()
    a, b = both
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, i, j = [], 0, 0
    for cut in cuts:
        left, right = [], []
        while i < len(a) and a[i][2] <= cut:
            left.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= cut:
            right.append(str(b[j][0]))
            j += 1
        groups.append(f"{','.join(left)}|{','.join(right)}")
    links, j = Counter(), 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links[x, b[k][0]] += 1
            k += 1
    return len(a), len(b), ";".join(groups), links


SPECIAL = [
    None, "", " ", "  ", "a", " a", "a ", "  two  spaces  ", "line\n next\n\n  end \n", "tab\t x", "<|endoftext|> and <s> </s> <unk>", "▁", "a▁b ok",
    "<0x41>", "\x00 zero", "naïve façade – “quotes”", "日本語のテキスト 東京", "🙂🙂 🇩🇪 é", " nbsp em", "\x1f \x85 x", "don't I'LL we've",
    "x" * 300_000, "東" * 40_000, "QUJD" * 20_000, "word " * 30_000, "\n" * 5000, " " * 5000, "a﻿b ​ c",
]


def test_units_give_what_whole_texts_give(aligner):
    random.seed(5)
    letters = ["a", "B", "é", "東", "🙂", " ", " ", " ", "\n", "\t", "'", "s", "1", "22", ".", "-", " ", " ", "▁", "<s>", "the", "\x1c", "́", "\U0003ec50", "İ"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(4000)] + SPECIAL
    found = aligner.align_many([t or "" for t in texts])
    for text, got in zip(texts, found, strict=True):
        n_a, n_b, groups, links = brute(aligner, text)
        pairs = Counter() if got is None else Counter(divmod(int(p), aligner.base) for p in np.frombuffer(got[4], dtype="<u4"))
        assert (0, 0, "", Counter()) == (n_a, n_b, groups, links) if got is None else (got[0], got[1], got[5], pairs) == (n_a, n_b, groups, links), repr(text)
        if got:
            assert got[2] == groups.count("|") and got[3] == sum(links.values())


def test_doubling_reaches_the_last_token():
    chain = np.array([*range(1, 1000), 999])
    assert alignment.terminals(chain).tolist() == [999] * 1000
    # One component: no common end but the last.
    ends_a, ends_b = np.arange(2, 2002, 2), np.append(np.arange(1, 2001, 2), 2000)
    assert set(alignment.terminals(alignment.pointers(ends_a, ends_b)).tolist()) == {2000}


def weighed(docs):
    rows = alignment.aligned(docs, A, B)
    held = alignment.chunk_pairs(rows)
    return alignment.weighed(rows, held, alignment.pair_counts(held, alignment.pieces(B)))


def expected(aligner, texts):
    each = [brute(aligner, t) for t in texts]
    count = Counter(p for *_, links in each for p in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = Counter()
    for n_a, n_b, groups, links in each:
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        out[n_a, n_b, groups.count("|"), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest()] += 1
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_counts_over_all_documents(spark, make_docs, aligner):
    texts = SPECIAL + ["the same text again"] * 40 + [f"hot word {i % 7} tail" for i in range(300)]
    docs = make_docs(list(enumerate(texts)), parts=5, n_a="x", links="p", pair="q", docs="d", best="b")
    rows = weighed(docs)
    assert {c: rows.first()[c] for c in ("pair", "docs", "best")} == {"pair": "q", "docs": "d", "best": "b"}
    got = Counter(tuple(r) for r in rows.select(*COLUMNS, F.sha2("groups", 256)).collect())
    assert got == expected(aligner, texts)


def test_repeated_ids_and_empty_table(spark, make_docs, aligner):
    texts = ["one two", "one two", "three", None]
    rows = weighed(make_docs([(1, t) for t in texts])).select(*COLUMNS, F.sha2("groups", 256)).collect()
    assert Counter(tuple(r) for r in rows) == expected(aligner, texts)
    assert weighed(make_docs([])).collect() == []
