"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def name(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, name(x[1:])))] for c, r in own.items()}
    out = {}
    for c, r in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + r[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = below[node]
        leaves = sum(sums[k][0] for k in kids) if kids else 1
        size = len(node[-1][1].encode()) if node else 0
        saved = (len(members[node]) - 1) * size + sum(sums[k][1] for k in kids)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = result(queries.queries()["op13_prefix_trie"](spark, sf))
    assert got == expected(rebuilt(rows)) and got


def copies(rng):
    """Hot first turns, copies, long and nested conversations, nulls, ties and repeats."""
    rows = []
    for c in range(-12, 150):
        seq = [("user", "Hello"), ("assistant", "Hi")] if c % 3 else [("user", rng.choice("abcde"))]
        seq += [(rng.choice(["user", None, ""]), rng.choice(["x", "yy", "zwölf", None, ""])) for _ in range(rng.choice([0, 1, 2, 2, 7]))]
        rows += [(c, t, *x) for t, x in enumerate(seq)]
    rows += [(c, t, "user", f"step {t}") for c in (200, 205, 210) for t in range(200 if c < 210 else 150)]
    rows += [(c, rng.choice([None, 0, 1]), "user", rng.choice("ab")) for c in range(300, 320) for _ in range(5)]
    rows += [(None, 1, "user", "no conversation")] * 3
    return rows


@pytest.mark.parametrize("turns,parts", [(1 << 19, "1"), (1 << 19, "4"), (20, "3"), (1, "2")])
def test_odd_conversations_over_any_shards(spark, turns, parts):
    rows = copies(random.Random(3))
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, key int, base string").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(trie.prefix_trie(df, turns)) == expected(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_many_copies_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_IDS", 16)
    rows = [(c, t, "user", f"same {t}") for c in range(-50, 400) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(trie.prefix_trie(df, 30)) == expected(rebuilt(rows))


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    bare = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(bare, 0, "user", "moves away")], schema)
    assert result(trie.prefix_trie(df)) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    assert trie.prefix_trie(df.filter(F.lit(False))).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0


def test_column_blocks_make_the_same_levels(monkeypatch):
    rng = np.random.default_rng(5)
    lens = rng.integers(1, 40, 300)
    raw = rng.integers(0, 2, (int(lens.sum()), 1)).astype(np.uint8).repeat(16, axis=1)
    args = lens, raw, np.ones(len(raw), np.int64), np.ones(300, np.int64), np.arange(300), [""] * 300
    whole = trie.levels(trie.Paths.of_conversations(*args))[1]
    for width in (7, 1):
        monkeypatch.setattr(trie, "COLUMNS", width)
        parts = trie.levels(trie.Paths.of_conversations(*args))[1]
        for a, b in zip(whole, parts, strict=True):
            assert (a.start == b.start).all() and (a.parent == b.parent).all() and all((a.sums[k] == b.sums[k]).all() for k in a.sums if k != "ends")
