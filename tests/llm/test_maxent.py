"""The language model against a direct version, its normalisation and its training."""

import math
from collections import namedtuple
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tideline.llm import maxent
from tideline.llm.textblock import U64, Words

Top = namedtuple("Top", "token c tail")
Sums = namedtuple("Sums", "tail c v")


def chunk_of(texts, held=None):
    chunk = maxent._Chunk()
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    chunk.add(list(range(len(texts))), held or [False] * len(texts), Words(data, offsets))
    return chunk.batch(0)


def cells(batch):
    ids, lens = maxent._from_planes(batch.column("ids")[0].as_py()), np.array(batch.column("lens")[0].as_py())
    vocab, tail = np.frombuffer(batch.column("vocab")[0].as_py(), U64), np.frombuffer(batch.column("tail")[0].as_py(), np.uint8)
    return ids, lens, vocab, tail, np.frombuffer(batch.column("counts")[0].as_py(), "<i8")


def model_of(batch, named=maxent.NAMED):
    *_, vocab, tail, counts = cells(batch)
    sums = [Sums(k, int(counts[(tail == k) & (counts > 0)].sum()), int(((tail == k) & (counts > 0)).sum())) for k in np.unique(tail)]
    order = np.argsort(-counts, kind="stable")[:named]
    return maxent.first_model([Top(int(vocab[i].view(np.int64)), int(counts[i]), int(tail[i])) for i in order if counts[i]], sums)


TEXTS = [f"the {'ab' * (i % 5 + 1)} of word{i} Ünder" for i in range(100)] + ["", "one"]


COLUMNS = ["doc_ids", "held", "lens", "ids", "vocab", "tail"]


def sums(model, turn, *batches):
    """Seen and drawn counts by weight, each batch a task of its own."""
    sent = [b for batch in batches for b in maxent._count(SimpleNamespace(value=model), turn)(iter([batch.select(COLUMNS)]))]
    seen, drawn = np.zeros((2, *model.weights.shape), np.float32)
    for out in maxent._add(iter(sent)):
        for block, *pair in zip(*(c.to_pylist() for c in out.columns), strict=True):
            for table, raw in zip((seen, drawn), pair, strict=True):
                if raw:
                    table[block * maxent.BLOCK_ROWS : (block + 1) * maxent.BLOCK_ROWS] = np.frombuffer(raw, np.float32).reshape(-1, maxent.WIDTH)
    return seen, drawn


def test_every_training_position_is_in_the_gradient():
    held = [i % 7 == 2 for i in range(len(TEXTS))]
    batch = chunk_of(TEXTS, held)
    ids, lens, vocab, tail, _ = cells(batch)
    model = model_of(batch)
    seen, drawn = sums(model, 0, batch)
    group, slot = model.places(vocab, tail)
    at = np.flatnonzero(~np.repeat(held, lens))
    rows = maxent.History(vocab, ids, lens).rows(at, group[ids[at]], len(model.weights) // 2)
    want = np.zeros_like(seen)
    for j, r in enumerate(rows):
        for row, outcome in zip(r, (group if j < maxent.FEATURES else slot)[ids[at]], strict=True):
            want[row, outcome] += 1
    assert (seen == want).all() and seen.sum() == 2 * maxent.FEATURES * len(at)
    assert (drawn.sum(axis=1) == seen.sum(axis=1)).all()  # a draw a position and feature
    later, again = sums(model, 1, batch)
    assert not later.any() and again.sum() == seen.sum() and (again != drawn).any()


def test_sums_do_not_see_how_documents_lie_in_chunks():
    ids = list(range(len(TEXTS)))
    whole = chunk_of(TEXTS)
    model = model_of(whole)

    def part(which):
        chunk = maxent._Chunk()
        texts = [TEXTS[i] for i in which]
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        chunk.add(list(which), [False] * len(texts), Words(np.frombuffer("".join(texts).encode(), np.uint8), offsets))
        return chunk.batch(7)

    for a, b in zip(sums(model, 0, whole), sums(model, 0, part(ids[40:][::-1]), part(ids[:40:2]), part(ids[1:40:2])), strict=True):
        assert (a == b).all()


def test_scores_do_not_depend_on_partitions(spark):
    texts = [" ".join(f"w{(i * 7 + j * j) % 23} of{(i + j) % 5}" for j in range(i % 40)) for i in range(400)] + ["", None] + ["the same row of words"] * 100
    rows = [(i if i < 450 else 450, t) for i, t in enumerate(texts)] + [(None, "no id here"), (2**63 - 1, "the last id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id is not None, r.doc_id, r.n_tokens, round(r.score, 3)) for r in maxent.score(docs.repartition(n)).filter("doc_id is not null").collect()) for n in (2, 16, 64)]
    assert len(got[0]) == len(rows) - 1
    for other in got[1:]:
        assert all(a[:3] == b[:3] and abs(a[3] - b[3]) <= 0.001 * a[2] for a, b in zip(got[0], other, strict=True))


def test_scores_equal_a_direct_version_and_add_up_to_one():
    batch = chunk_of(TEXTS)
    ids, lens, vocab, tail, counts = cells(batch)
    model = model_of(batch, named=60)
    rng = np.random.default_rng(4)
    model = replace(model, weights=rng.normal(0, 0.3, model.weights.shape).astype(np.float32))
    group, slot = model.places(vocab, tail)
    buckets = len(model.weights) // 2
    hashed = lambda key, j: (int(key) * int(maxent._ODD[j]) % 2**64) >> (64 - buckets.bit_length() + 1)

    def soft(prior, rows):
        x = np.clip(prior.astype(float) + sum(model.weights[r].astype(float) for r in rows), -60, 60)
        return np.exp(x) / np.exp(x).sum()

    def direct(text, at):
        """Probability of every known token and of anything unseen, by class."""
        line = [*map(int, maxent.START[::-1]), *(int(vocab[i]) for i in text)]
        a, b, c = line[at + 2], line[at + 1], line[at]
        keys = [a, (a * int(maxent._ODD[0]) + b * int(maxent._ODD[1])) % 2**64, b ^ 0x5851F42D4C957F2D, c ^ 0x14057B7EF767814F]
        by_class = soft(model.class_prior, [hashed(k, j) for j, k in enumerate(keys)])
        known, unseen = np.zeros(len(vocab)), 0.0
        for k in range(maxent.WIDTH):
            inside = (k + 1) * 0x9E3779B97F4A7C15 % 2**64
            by_slot = soft(model.slot_prior[k], [buckets + hashed(key ^ inside, maxent.FEATURES + j) for j, key in enumerate(keys)])
            for i in np.flatnonzero(group == k):
                known[i] = by_class[k] * by_slot[slot[i]] * ((counts[i] + 1) / model.mass[k] if slot[i] == 0 else 1)
            used = {0, *slot[group == k].tolist()}
            unseen += by_class[k] * (by_slot[0] / model.mass[k] + sum(by_slot[j] for j in range(maxent.WIDTH) if j not in used))
        return known, unseen

    known = np.stack([np.arange(len(vocab)), counts], axis=1).astype("<i8").tobytes()
    got = next(iter(maxent._scores(SimpleNamespace(value=model))(iter([batch.drop_columns(["counts"]).append_column("known", pa.array([known], pa.binary()))]))))
    first = np.cumsum(lens) - lens
    for d in (0, 17, 63, 100, 101):
        text = ids[first[d] : first[d] + lens[d]].tolist()
        total = 0.0
        for at in range(len(text)):
            p, rest = direct(text, at)
            assert math.isclose(p.sum() + rest, 1, rel_tol=1e-5)
            total += math.log10(p[text[at]])
        assert math.isclose(got.column("score")[d].as_py(), total, rel_tol=1e-4)


def test_draws_follow_the_softmax():
    rng = np.random.default_rng(0)
    logits = np.tile(rng.normal(0, 2, maxent.WIDTH).astype(np.float32), (200_000, 1))
    want = np.exp(logits[0]) / np.exp(logits[0]).sum()
    seen = np.bincount(maxent._draw(logits, rng.random(len(logits), np.float32)), minlength=maxent.WIDTH) / len(logits)
    assert np.abs(seen - want).max() < 0.005


def test_rounds_learn_what_follows_what():
    texts = ["a b c d a b c d a b c d", "d c b a d c b a"] * 200
    batch = chunk_of(texts)
    ids, lens, vocab, tail, _ = cells(batch)
    model = model_of(batch)
    group, slot = model.places(vocab, tail)
    history, every = maxent.History(vocab, ids, lens), np.arange(len(ids))
    before = model.log_probs(history, every, group[ids], slot[ids]).mean()
    seen = None
    for turn in range(12):
        first, drawn = sums(model, turn, batch)
        seen = first if turn == 0 else seen
        model = replace(model, weights=maxent.moved(model.weights, seen, drawn, 0.4))
    assert model.log_probs(history, every, group[ids], slot[ids]).mean() > before + 0.5


def test_broadcast_and_joined_counts_give_the_same_rows(spark):
    texts = [f"the {'ab' * (i % 5 + 1)} of word{i} word{i % 9}" for i in range(200)] + ["", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    joined, mixed, every = (sorted(maxent.score(docs, n).select(columns).collect()) for n in (1, 50, maxent.FREQUENT))
    assert joined == mixed == every
    learnt = [r.doc_id for r in every if not r.held_out]
    known = {w for i in learnt for w in (texts[i] or "").split()}
    assert all(r.n_known == 1 + sum(w in known for w in (texts[r.doc_id] or "").split()) for r in joined)
