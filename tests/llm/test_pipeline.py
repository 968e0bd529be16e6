import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitegauge.llm import ordinal, suffixes
from sitegauge.llm.queries import grades
from tests.llm.test_simhash import brute_components, plain_print

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_run_against_brute_force(spark):
    read = lambda n: spark.read.parquet(f"{SF_DIR}/{n}.parquet")
    docs = read("documents")
    model = ordinal.fit(docs, grades(spark, SF_DIR))
    rows = {r.doc_id: r.text for r in docs.collect()}
    score = lambda t: sum(model.weights.get(f, 0) for f in ordinal.features((t or "").encode()))
    rows = {i: t for i, t in rows.items() if model.tails(np.array([score(t)]))[0, -1] >= 0.5}
    rows = {max(i for i, u in rows.items() if u == t): t for t in set(rows.values())}
    ids = sorted(rows)
    roots = brute_components([plain_print(rows[i]) for i in ids])
    rows = {ids[r]: rows[ids[r]] for r in set(roots)}
    windows = set()
    for item in read("benchmark").collect():
        w = suffixes.words_of(item.text.encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    words = {i: suffixes.words_of(t.encode()) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not any(tuple(words[i][k : k + 10]) in windows for k in range(len(words[i])))}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    got = {r.doc_id: np.frombuffer(r.token_ids, dtype="<u4").tolist() for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want


def test_stages_keep_the_columns_and_bear_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (9, "long " * 50_000)], text_sha256="s", token_ids="t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF_DIR)
            assert out.columns == docs.columns, name
            assert out.count() <= some.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 6
