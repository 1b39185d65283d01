"""Edited, partial, short, repetitive and very long passages against brute force."""

import resource
import time

import numpy as np

from tideline.llm import decontaminate as D


def run(items, texts):
    index = D.build([(i, t.encode()) for i, t in items])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    return {(r, item) for r, item, *_ in D.search(index, data, offsets)}


def distance_to_part(pattern, text):
    """Fewest edits of ``pattern`` against any part of ``text``, by the whole table."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern, 1):
        step = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        new = np.concatenate([[i], step])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_every_region_within_the_budget_is_found():
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghij "))
    noise = lambda n: "".join(rng.choice(letters, n))
    items = [(i, noise(int(rng.integers(24, 260))).strip() + "x") for i in range(25)]
    texts = []
    for _ in range(60):
        passage = list(items[rng.integers(0, 25)][1])
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(passage)))
            passage[at] = ["", "z", passage[at] + "y"][rng.integers(0, 3)]
        texts.append(noise(int(rng.integers(0, 200))) + "".join(passage) + noise(int(rng.integers(0, 200))))
    want = set()
    for r, t in enumerate(texts):
        norm = D.normalise(np.frombuffer(t.encode(), np.uint8))[0].tobytes()
        for i, p in items:
            p = D.normalise(np.frombuffer(p.encode(), np.uint8))[0].tobytes().strip()
            last = max(0, len(p) - D.SEGMENT)
            segments = [p[a : a + D.SEGMENT] for a in {*range(0, last, D.SEGMENT // 2), last}]
            if any(distance_to_part(s, norm) <= D.budget(len(s)) for s in segments):
                want.add((r, i))
    assert run(items, texts) == want and len(want) > 20


def test_part_of_a_passage_short_items_and_shared_phrases():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    long = " ".join(word() for _ in range(60))
    items = [(1, long), (2, "Paris, France"), (3, "yes")] + [(10 + i, "the following is a question about " + " ".join(word() for _ in range(12))) for i in range(100)]
    quote = long[101 : 101 + 3 * D.SEGMENT // 2]
    texts = ["so " + quote + " it says", "in PARIS,  france now", "comparis, france", "yes yes", "the following is a question about nothing at all", "oh " + items[50][1]]
    assert run(items, texts) == {(0, 1), (1, 2), (5, items[50][0])}


def test_runs_of_one_character_and_very_long_texts_stay_bounded():
    dashes = "-" * 300
    rng = np.random.default_rng(2)
    plain = "".join(rng.choice(list("abcdefgh "), 20_000_000))
    passage = "".join(rng.choice(list("ijklmnop "), 200))
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    items = [(1, dashes), (2, passage)] + [(10 + i, passage[:100] + "".join(rng.choice(list("qrst"), 90))) for i in range(300)]
    assert run(items, ["-" * 1_000_000, plain[:10_000_000] + passage + plain[10_000_000:], (passage[:100] + " ") * 300]) >= {(0, 1), (1, 2), (2, 2)}
    assert time.time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


def test_a_passage_larger_than_a_block_is_cut(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 40_000))
    items = spark.createDataFrame([(1, text), (2, text[:200])], "item_id long, text string")
    got = list(D.blocks(items, 8000))
    assert max(sum(len(t) for _, t in b) for b in got) < 24_000
    parts = [t.decode() for b in got for i, t in b if i == 1]
    assert all(any(text[a : a + D.SEGMENT] in p for p in parts) for a in range(0, len(text) - D.SEGMENT, 97))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_short_items_are_found_whole_with_their_edits():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 7))))
    phrase = lambda n: " ".join(word() for _ in range(9))[:n].strip().ljust(n, "x")
    items = [(i, phrase(8 + i % 16)) for i in range(48)]
    texts = []
    for _ in range(400):
        passage = list(items[rng.integers(0, len(items))][1])
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(passage)))
            passage[at] = ["", "z", passage[at] + "y"][rng.integers(0, 3)]
        texts.append(word() + rng.choice([" ", "; ", ""]) + "".join(passage) + rng.choice([", ", ".", ""]) + word())
    want = set()
    for r, t in enumerate(texts):
        whole = [i for i in range(len(t) + 1) if i in (0, len(t)) or not (t[i - 1].isalnum() and t[i].isalnum())]
        starts, ends = [i for i in whole if i == 0 or not t[i - 1].isalnum()], [i for i in whole if i == len(t) or not t[i].isalnum()]
        for i, p in items:
            q, edits = D._short(p.encode())
            if len({p[j : j + q] for j in range(len(p) - q + 1)}) <= q * edits:
                edits = 0
            if any(abs(e - s - len(p)) <= edits and levenshtein(p, t[s:e]) <= edits for s in starts for e in ends):
                want.add((r, i))
    assert run(items, texts) == want and len(want) > 80
    assert run([(1, "What is the capital?"), (2, "Paris, France")], ["so: What is teh capital? Now", "in paris france", "comparis, france"]) == {(0, 1), (1, 2)}


def test_segments_that_repeat_bear_some_edits():
    rng = np.random.default_rng(12)
    for period, edits in ((14, 1), (30, 2), (45, 3)):
        once = "".join(rng.choice(list("abcdefghijklmnop"), period))
        item = (once * 9)[: D.SEGMENT]
        for _ in range(20):
            text = list(item)
            for at in rng.choice(len(text), edits, replace=False):
                text[at] = "Z"
            assert run([(1, item)], ["so " + "".join(text) + " then"]) == {(0, 1)}


def test_shorter_segments_find_shorter_quotes_everywhere(spark):
    rng = np.random.default_rng(13)
    long = "".join(rng.choice(list("abcdefghijklmnop "), 182)).strip()
    docs = [(i, "before " + long[i : i + 60] + " after") for i in range(len(long) - 60)]
    docs += [(1000, "nothing of it"), (1001, None), (1002, "go far")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, long), (2, "go far"), (3, None)], "item_id long, text string")
    found = lambda **given: {(r.doc_id, r.item_id) for r in D.find(frame, items, **given).collect()}
    quotes = {(i, 1) for i in range(len(long) - 60)}
    assert found(segment=40) == quotes
    assert found(segment=40, shortest=6) == quotes | {(1002, 2)}
    assert {r.doc_id for r in D.clean(frame, items, segment=40).collect()} == {1000, 1001, 1002}
    assert found(edit_rate=0.0) < quotes
