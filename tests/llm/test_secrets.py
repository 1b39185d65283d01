"""Short and signed passwords, labelled findings, repeated rows, and the forest against an exhaustive search."""

import time

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import forest, secrets

HEXA = "9f86d081884c7d659a2feaa0c55ad015"


def test_short_values_and_other_characters_are_candidates(spark):
    texts = ['password = "hunter2!"', "PWD: c0rrect.horse#battery", 'db_secret => "a@b#cd"', "the password: please remember", "token: yes", f"see {HEXA} there", "Password = secret word"]
    texts += [f"see {HEXA[i:]}{HEXA[:i]} there" for i in range(1, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")  # no source
    rows = {(r.doc_id, texts[r.doc_id][r.start : r.end]): r.secret for r in secrets.scan(docs).collect()}
    assert rows == {(0, "hunter2!"): True, (1, "c0rrect.horse#battery"): True, (2, "a@b#cd"): True, (5, HEXA): False} | {(6 + i, HEXA[i:] + HEXA[:i]): False for i in range(1, 9)}
    safe = [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert safe[:4] == ['password = "[SECRET]"', "PWD: [SECRET]", 'db_secret => "[SECRET]"', texts[3]] and safe[5] == texts[5]


def test_given_labels_decide_and_repeated_rows_are_one_finding(spark):
    rows = [(i, f"see {HEXA[i % 16:]}{HEXA[:i % 16]} on path{i % 2}", "a" if i % 2 else "test") for i in range(60)]
    docs = spark.createDataFrame(rows * 5, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 4, 36, bool(i % 2)) for i in range(40)] * 3, "doc_id long, start long, end long, secret boolean")
    got = {r.doc_id: r.secret for r in secrets.scan(docs, labels).collect()}
    assert got == {i: bool(i % 2) for i in range(60)}
    found = secrets.find(docs, secrets.corpus_of(docs))
    assert found.count() == 300
    model = secrets.train(found, labels)
    assert abs(model.prior - 0.5) < 1e-9


def test_corpus_figures_equal_a_direct_count(spark):
    texts = ["the cat sat", "The Dog-42", "", None, "été été"]
    corpus = secrets.corpus_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pairs = np.ones((secrets.PAIRS, secrets.PAIRS))
    for t in texts:
        raw = (t or "").encode()
        for a, b in zip(raw, raw[1:]):
            pairs[secrets._PAIR[a], secrets._PAIR[b]] += 1
    assert np.allclose(corpus.bits, -np.log2(pairs / pairs.sum(axis=1, keepdims=True)))
    assert corpus.covered(b"cat12dog") == 6 / 8 and corpus.covered(b"xyzzy") == 0
    assert corpus.surprise(b"qx") > corpus.surprise(b"th")


def test_forest_scores_and_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (200, 3)).astype(np.float32)
    y = (x[:, 1] > 2).astype(float)
    model = forest.fit(x, y, trees=5, depth=2)
    for row, got in zip(x, model.score(x), strict=True):
        total = 0.0
        for t in range(5):
            node = 0
            while node < 3:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - 3]
        assert abs(total / 5 - got) < 1e-12
    # the root of a tree that saw column 1 splits it where one side is pure
    for t in range(5):
        if model.feature[t, 0] == 1:
            assert 2 <= model.threshold[t, 0] < 3


def test_a_text_with_many_candidates_is_masked_in_linear_time(spark):
    text = " ".join(f'token = "{i:08d}{HEXA}"' for i in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert secrets.redact(docs).select(F.expr("regexp_count(text, 'SECRET')")).first()[0] == 30_000
    assert time.time() - began < 60
