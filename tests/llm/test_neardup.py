"""Large groups of alike texts: links are kept, rounds do not grow with the group."""

import numpy as np
import pytest

from tideline.llm import neardup, store

from .test_contracts import components, shingles


def _template(n, rng, common=70, own=30):
    """Pages that share most words but are below the threshold, a few linked copies among them."""
    word = lambda: f"w{rng.integers(0, 10**9)}"
    page = [word() for _ in range(common)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(page + [word() for _ in range(own)])))
    for i in range(0, n, 10):
        base = rows[i][1].split()
        base[int(rng.integers(common, common + own))] = word()
        rows.append((n + i, " ".join(base)))
    return rows


def _rounds(monkeypatch, spark, rows, **caps):
    jobs = []
    keep = store.Scratch.keep
    monkeypatch.setattr(store.Scratch, "keep", lambda self, df, name="t": (jobs.append(name), keep(self, df, name))[1])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **caps).collect()}
    return got, sum(j == "hubs" for j in jobs)


@pytest.mark.parametrize("n", [60, 240])
def test_template_pages_need_a_fixed_number_of_rounds(monkeypatch, spark, n):
    rows = _template(n, np.random.default_rng(n))
    got, rounds = _rounds(monkeypatch, spark, rows, node_cap=8, cluster_cap=8)
    assert got == components({i: shingles(t, 4) for i, t in rows}, 80)
    assert rounds <= neardup.HUB_ROUNDS


def test_prefix_lists_hold_every_linked_pair(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(80)]
    rows = spark.createDataFrame([(5, i, x.tobytes()) for i, x in enumerate(sets)], "grp long, rep long, shingles binary")
    held = {}
    for r in neardup._prefix_lists(rows, 70, store.Scratch(spark, "lists")).collect():
        held.setdefault(r.grp, set()).add(r.rep)
    for i in range(80):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 70 * (len(sets[i]) + len(sets[j]) - inter):
                assert any({i, j} <= m for m in held.values())


def test_long_lists_of_pages_that_hubs_do_not_link_are_cut_into_blocks(monkeypatch, spark):
    """What pages share is in each one's prefix, most are below the threshold: a hub a round would go on for as many rounds as there are pages."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    page = [word() for _ in range(80)]
    rows = [(i, " ".join(page + [word() for _ in range(10 + i % 5)])) for i in range(40)]
    rows += [(40 + i, rows[i][1] + " " + word()) for i in range(0, 40, 8)]
    got, rounds = _rounds(monkeypatch, spark, rows, node_cap=8, cluster_cap=8)
    assert got == components({i: shingles(t, 4) for i, t in rows}, 80)
    assert rounds <= 3 * neardup.HUB_ROUNDS


def test_parities_never_tell_more_than_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 500, n)) for n in rng.integers(1, 300, 60)]
    parity = neardup._parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for i in range(60):
        for j in range(i):
            assert np.bitwise_count(parity[i] ^ parity[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
