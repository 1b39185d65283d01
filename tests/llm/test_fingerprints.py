"""Fingerprints against plain Python: spans, extensions, edits, order of documents."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import fingerprints as fp
from tideline.llm import queries


def prints(text):
    return fp.fingerprint(np.frombuffer(text.encode(), np.uint8))


@settings(max_examples=200, deadline=None)
@given(st.text("abä\n", max_size=60), st.text("abä\n", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    a, b = a.encode(), b.encode()
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    pa, pb = fp.PrefixHashes(a), fp.PrefixHashes(b)
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert pa.extension(i, pb, j) == n
    m = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (pa.span(i, i + m) == pb.span(j, j + m)) == (a[i : i + m] == b[j : j + m])


def test_segments_do_not_change_hashes(monkeypatch):
    text = np.random.default_rng(1).integers(97, 105, 5000).astype(np.uint8)
    whole, print_ = fp.PrefixHashes(text).at, str(fp.fingerprint(text))
    for size in (1000, 8, 3):
        monkeypatch.setattr(fp, "SEGMENT", size)
        assert (fp.PrefixHashes(text).at == whole).all()
        assert str(fp.fingerprint(text)) == print_


def test_fingerprint_holds_prefix_hashes_of_chosen_positions():
    text = b"".join(bytes([random.Random(i).randrange(97, 123)]) for i in range(3000))
    p, f = fp.PrefixHashes(text), fp.fingerprint(np.frombuffer(text, np.uint8))
    for e, v in zip(f.ends, f.values):
        assert v == tuple(int(x) for x in p.at[:, e])
    assert 4 <= len(f.ends) <= 60 and f.ends[-1] == len(text)
    again = fp.Fingerprint.parse(str(f))
    assert str(again) == str(f) and fp.likeness(f, again) == 1.0
    at, spans, _ = f.spans(f.least)
    assert spans == [(b - a, *p.span(a, b)) for a, b in zip(at[:-1], at[1:])]


def test_coarser_choice_is_part_of_the_finer_one():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    f = prints(text)
    long = prints(text + "".join(rng.choice("abcdefgh ") for _ in range(60000)))
    inside = {e for e in long.ends[:-1] if e <= len(text)}
    assert inside <= {e for e, lv in zip(f.ends, f.levels) if lv >= long.least}


def test_likeness_follows_shared_text():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b = word(6000), word(6000)
    assert fp.likeness(prints(a), prints(b)) < 0.05
    assert 0.45 < fp.likeness(prints(a), prints(a[:4000] + b[:2000])) < 0.72
    assert fp.likeness(prints(a), prints(a[:3000] + "x" + a[3000:])) > 0.75
    assert fp.likeness(prints(a), prints("new start " + a)) > 0.75
    assert fp.likeness(prints(""), prints("")) == 1.0 and fp.likeness(prints(""), prints("a")) == 0.0
    assert fp.likeness(prints("short"), prints("short")) == 1.0 and fp.likeness(prints("short"), prints("shore")) == 0.0
    same = prints("ab" * 50000)
    assert len(same.ends) <= 4  # each distinct window once


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(prints(t)), str(prints(e)), fp.likeness(prints(t), prints(e)), fp.likeness(prints(t), prints(u))))
    return sorted(want, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = result(queries.queries()["op12_prefix_fingerprints"](spark, sf))
    assert got == expected(rows) and got
    edited = [r[5] for r in got if r[1] > 200]
    assert sum(edited) / len(edited) > 0.5 and sum(r[5] > r[6] for r in got if r[1] > 200) > 0.9 * len(edited)
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r[0]] or "", r[3]) == r[3]
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("parts", ["1", "3", "50"])
def test_odd_texts_over_any_shards(spark, parts):
    rng = random.Random(6)
    texts = [None, "", " ", "é", "日本語のテキスト" * 30, "a" * 1000, "x\ny\n" * 50, "🙂🙃" * 7, "plain words " * 20]
    rows = [(i, rng.choice(texts)) for i in range(-10, 40)] + [(100, "word " * 300_000), (101, "w" * 1_200_000)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, shard int, hash string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(fp.fingerprints(df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repeats_single_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    copies = spark.createDataFrame([(7, "the same text, many times over")] * 300 + [(None, "without id"), (3, "another text entirely")], schema)
    got = result(fp.fingerprints(copies))
    assert got == expected([tuple(r) for r in copies.collect()])
    one = spark.createDataFrame([(1, "abcdef")], schema)
    assert result(fp.fingerprints(one))[0][2] == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.fingerprints(one.filter(F.lit(False))).count() == 0
