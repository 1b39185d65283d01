"""Hashed maximum-entropy language model with a class-factored softmax.

p(w | h) = p(class(w) | h) * p(slot(w) | class(w), h) * p(w | slot). Tokens fall
into ``WIDTH`` classes by their last letters. The most frequent ones have slots
of their own in their class, at most ``WIDTH - 1``; all others share slot 0,
where a token has its add-one share of the training counts, with one share for
everything unseen; so the model is normalised over any vocabulary. Both softmaxes
sum weight rows of hashed features of the history: the word before, the two words
before, and skip features for the second and third word before; the slot's
rows are hashed from feature and class.

Work is laid out in chunks of many documents. One scan turns each chunk into
local token numbers and the chunk's distinct token hashes with their training
counts; counts are then summed over all chunks by token. Those of tokens with at
least one ``FREQUENT``-th of all training tokens, so at most ``FREQUENT`` of them,
are broadcast in 16 bytes each; those of all other tokens are sent back by a join,
one row a token and chunk instead of one a token and document. The gradient of a
weight is (how often its feature and outcome are there) - (how often the model
expects them), over every training position of the corpus. The expectation is
taken by one draw a position from the model, which has the same mean as the whole
sum and touches one weight a feature instead of ``WIDTH``; the draw is hashed from
the document, its id and the position. So both sides are whole counts, which tasks
add up for their chunks and one shuffle for all tasks, and no score depends on how
rows lie in partitions. A round moves each weight by its ``RATES`` times the log of
there over expected, both damped: the step of iterative scaling, which needs no
learning rate by feature. Sums leave a task as compressed blocks of ``BLOCK_ROWS`` rows.

The weights are a table of 2 x ``buckets`` rows that is sent to every task.
``buckets`` grows with the training tokens from 2^14 to ``most_buckets`` (2^16 unless
said otherwise, where the table has 25 MB); counts and positions grow with the corpus
without bound. Tokens are compared by 64-bit hashes.

Defined results
* null or empty text: the end token alone
* null ``doc_id``: a training document
* repeated rows count as often as they occur; rows equal in id and text draw alike
* without training documents every token is unseen and every class has one share; an empty table gives no rows; more columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .store import Scratch
from .textblock import LOWER, U64, Words, arrow_bytes, mix, slices, trim, trimmed

WIDTH = 48
NAMED = 4096  # frequent tokens looked at for slots
FREQUENT = 1 << 18  # 4 MB of hashes and counts
BUCKETS = (1 << 14, 1 << 16)
TOKENS_A_BUCKET = 8192
RATES = (0.5, 0.4)  # one a round
DAMPING = 8.0  # a weight seen a few times moves little
MOST = 6.0  # log ratio of one round
BATCH = 1 << 18  # positions counted at a time
BLOCK_ROWS = 64  # weight rows a block of sums
TASKS_A_CORE = 4  # of a round: each task sends its sums once
SLICE = 1 << 14  # positions whose probabilities are held at a time
CHUNK_BYTES = 8 << 20
END = np.uint64(1)
START = (np.uint64(2), np.uint64(3), np.uint64(5))
FEATURES = 4
NEVER = np.float32(-60.0)

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lens array<int>, ids binary, vocab binary, tail binary, counts binary"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _planes(ids: np.ndarray) -> bytes:
    """Token numbers byte by byte and compressed: frequent tokens have small numbers, high bytes are mostly empty."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(ids).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _from_planes(raw: bytes | pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(pa.decompress(memoryview(raw)[8:], 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _cells(batch: pa.RecordBatch, names: str) -> Iterator[list]:
    """Row by row; binary cells as buffers, without a copy."""
    for i in range(batch.num_rows):
        row = [batch.column(n)[i] for n in names.split()]
        yield [x.as_buffer() if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type) else x.as_py() for x in row]


def _tails(words: Words) -> np.ndarray:
    """Class number by a word's last two bytes, lowered; its own kind for one-byte words."""
    last = LOWER[words.data[words.end - 1]].astype(np.int64)
    before = np.where(words.end - words.start > 1, LOWER[words.data[np.maximum(words.end - 2, 0)]], 0).astype(np.int64)
    return (mix((last * 256 + before).astype(U64)) % U64(WIDTH)).astype(np.uint8)


class _Chunk:
    def __init__(self) -> None:
        self.doc_ids: list = []
        self.held: list = []
        self.lens: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.tails: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_ids: list, held: list, words: Words) -> None:
        n = words.counts()
        total = len(words.hash) + len(n)
        place = np.arange(len(words.hash)) + np.repeat(np.arange(len(n)), n)
        tokens, tails = np.full(total, END), np.zeros(total, np.uint8)
        tokens[place], tails[place] = words.hash, _tails(words)
        self.doc_ids += doc_ids
        self.held += held
        self.lens.append(n + 1)
        self.tokens.append(tokens)
        self.tails.append(tails)
        self.bytes += len(words.data) + 64 * len(n)

    def batch(self, chunk: int) -> pa.RecordBatch:
        tokens, lens = np.concatenate(self.tokens), np.concatenate(self.lens)
        vocab, first, ids, count = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent tokens get small numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        ids = number[ids]
        training = np.repeat(~np.array(self.held, bool), lens)
        counts = np.bincount(ids[training], minlength=len(vocab))
        tail = np.concatenate(self.tails)[first][order]
        cells = [[chunk], [self.doc_ids], [self.held], [lens.astype(np.int32)], [_planes(ids)], [vocab[order].tobytes()], [tail.tobytes()], [counts.astype("<i8").tobytes()]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    chunk = _Chunk()
    for batch in batches:
        ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        data, offsets = arrow_bytes(batch.column(1))
        for a, b in slices(offsets):
            base = offsets[a]
            chunk.add(ids[a:b], held[a:b], Words(data[base : offsets[b]], offsets[a : b + 1] - base))
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk.batch(number)
                number += 1
                chunk = _Chunk()
    if chunk.doc_ids:
        yield chunk.batch(number)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, vocab, tail, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            token = np.frombuffer(vocab, np.int64)
            cols = [np.full(len(token), chunk), np.arange(len(token), dtype=np.int32), token, np.frombuffer(tail, np.uint8).astype(np.int16), np.frombuffer(counts, "<i8")]
            for a in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in cols], ["chunk", "pos", "token", "tail", "n"])


@dataclass
class Frequent:
    """Training counts of the tokens that most chunks hold; at most ``FREQUENT`` of them."""

    token: np.ndarray  # hashes, ascending
    count: np.ndarray

    @staticmethod
    def of(total: DataFrame, train_tokens: int, most: int) -> Frequent:
        rows = total.filter(F.col("c") * F.lit(most) >= F.lit(train_tokens)).select("token", "c").toPandas()
        token, count = rows["token"].to_numpy(np.int64).view(U64), rows["c"].to_numpy(np.int64)
        order = np.argsort(token)
        return Frequent(token[order], count[order])

    def find(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are frequent, and the counts of these."""
        if not len(self.token):
            return np.zeros(len(vocab), bool), self.count
        at = np.minimum(np.searchsorted(self.token, vocab), len(self.token) - 1)
        hit = self.token[at] == vocab
        return hit, self.count[at[hit]]


def _others(frequent):
    """Place of each token whose count is not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab in _cells(batch, "chunk vocab"):
                token = np.frombuffer(vocab, U64)
                pos = np.flatnonzero(~frequent.value.find(token)[0]).astype(np.int32)
                for a in range(0, len(pos), 100_000):
                    p = pos[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), chunk)), pa.array(p), pa.array(token[p].view(np.int64))], ["chunk", "pos", "token"])

    return run


@dataclass
class Model:
    """Bounded parameters: tokens with slots, priors, weights."""

    named: np.ndarray  # hashes, ascending
    named_class: np.ndarray
    named_slot: np.ndarray
    mass: np.ndarray  # of each class's slot 0: add-one counts, with one share for the unseen
    class_prior: np.ndarray  # log shares, where the weights start from
    slot_prior: np.ndarray
    train_tokens: int
    distinct: int
    weights: np.ndarray  # rows of classes, then rows of slots

    def places(self, vocab: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each token."""
        group, slot = tail.astype(np.int64), np.zeros(len(vocab), np.int64)
        if len(self.named):
            at = np.minimum(np.searchsorted(self.named, vocab), len(self.named) - 1)
            hit = self.named[at] == vocab
            group[hit], slot[hit] = self.named_class[at[hit]], self.named_slot[at[hit]]
        return group, slot

    def log_probs(self, history: History, part: np.ndarray, group: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Natural log of p(class) * p(slot) at the positions ``part``."""
        rows = history.rows(part, group, len(self.weights) // 2)
        total = np.zeros(len(part))
        for which, logits in ((group, self.class_logits(rows)), (slot, self.slot_logits(rows, group))):
            total += np.take_along_axis(logits, which[:, None], axis=1)[:, 0]
            total -= np.log(np.exp(logits, out=logits) @ _ONES)
        return total

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        out = _row_sum(self.weights, rows[:FEATURES])
        out += self.class_prior
        return np.clip(out, NEVER, -NEVER, out=out)

    def slot_logits(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = _row_sum(self.weights, rows[FEATURES:])
        out += self.slot_prior.take(group, axis=0)
        return np.clip(out, NEVER, -NEVER, out=out)


_ONES = np.ones(WIDTH, np.float32)
_ODD = mix(np.arange(11, 11 + 2 * FEATURES, dtype=U64)) | U64(1)


def _row_sum(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[0], axis=0, mode="clip")
    more = np.empty_like(out)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=more, mode="clip")
        out += more
    return out


class History:
    """Texts of a chunk in a row, three start marks before each."""

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, lens: np.ndarray):
        self.at = np.arange(len(ids), dtype=np.int32) + np.repeat(3 * np.arange(1, len(lens) + 1, dtype=np.int32), lens)
        self.line = np.empty(len(ids) + 3 * len(lens), U64)
        first = self.at[np.cumsum(lens) - lens].astype(np.int64)
        for k, mark in enumerate(START, 1):
            self.line[first - k] = mark
        self.line[self.at] = vocab[ids]

    def rows(self, part: np.ndarray, group: np.ndarray, buckets: int) -> np.ndarray:
        """Weight rows by feature: ``FEATURES`` for the class, then as many for the slot in class ``group``."""
        at = self.at[part]
        a, b, c = (self.line[at - k] for k in (1, 2, 3))
        keys = (a, a * _ODD[0] + b * _ODD[1], b ^ U64(0x5851F42D4C957F2D), c ^ U64(0x14057B7EF767814F))
        inside = (group.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        shift = U64(65 - buckets.bit_length())
        out = np.empty((2 * FEATURES, len(part)), np.int64)
        for j, key in enumerate(keys):
            out[j] = (key * _ODD[j]) >> shift
            out[FEATURES + j] = ((key ^ inside) * _ODD[FEATURES + j]) >> shift
        out[FEATURES:] += buckets
        return out


_BLOCK = 8
_UP_TO = np.repeat(np.tri(WIDTH // _BLOCK, dtype=np.float32), _BLOCK, axis=1)  # sums of the first blocks of outcomes


def _draw(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One outcome a row, by its probability: first a block of outcomes, then one in it."""
    e = np.exp(logits, out=logits)
    upto = _UP_TO @ e.T
    left = u * upto[-1]
    block = np.zeros(len(u), np.int64)
    before = np.zeros(len(u), np.float32)
    for x in upto[:-1]:
        past = x <= left
        block += past
        np.copyto(before, x, where=past)
    left -= before
    part = e.reshape(-1, _BLOCK).take(np.arange(len(u)) * (WIDTH // _BLOCK) + block, axis=0)
    inside, total = np.zeros(len(u), np.int64), np.zeros(len(u), np.float32)
    for j in range(_BLOCK - 1):
        total += part[:, j]
        inside += total <= left
    return block * _BLOCK + inside


def _keys(doc_ids: list, vocab: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash a position: of the document's id, its tokens in order and the place in it."""
    first = np.cumsum(lens) - lens
    place = np.arange(len(ids), dtype=U64) - np.repeat(first.astype(U64), lens)
    place *= U64(2)
    place += U64(1)
    text = np.add.reduceat(mix(vocab)[ids] * place, first)
    number = np.array([0 if d is None else d for d in doc_ids], np.int64).view(U64)
    return np.repeat(mix(text ^ mix(number)), lens) + place * U64(0x9E3779B97F4A7C15)


def _chances(keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Two even numbers from 0 to 1 a position; the same wherever the position is handled."""
    h = mix(keys ^ U64((turn + 1) * 0xD1B54A32D192ED03 % 2**64))
    return tuple((x & U64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24) for x in (h >> U64(40), h >> U64(8)))


def _pack(counts: np.ndarray) -> bytes:
    """Whole numbers byte by byte and compressed: high bytes are mostly empty."""
    return pa.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * BLOCK_ROWS * WIDTH, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


SUMS = "block int, seen binary, drawn binary"


def _count(shared, turn: int):
    """How often each weight's feature and outcome are there (in the first round) and are drawn, by blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        sums = [np.zeros(model.weights.size, np.int64) for _ in range(1 if turn else 2)]
        for batch in batches:
            for doc_ids, held, lens, ids, vocab, tail in _cells(batch, "doc_ids held lens ids vocab tail"):
                ids, lens, vocab = _from_planes(ids), np.array(lens, np.int64), np.frombuffer(vocab, U64)
                group, slot = model.places(vocab, np.frombuffer(tail, np.uint8))
                history, keys = History(vocab, ids, lens), _keys(doc_ids, vocab, ids, lens)
                at = np.flatnonzero(np.repeat(~np.array(held, bool), lens)).astype(np.int32)
                for a in range(0, len(at), BATCH):
                    cells: list[list[np.ndarray]] = [[] for _ in sums]
                    for i in range(a, min(a + BATCH, len(at)), SLICE):
                        part = at[i : min(i + SLICE, a + BATCH)]
                        g, s = group[ids[part]], slot[ids[part]]
                        rows = history.rows(part, g, len(model.weights) // 2)
                        u, v = _chances(keys[part], turn)
                        drawn = _draw(model.class_logits(rows), u), _draw(model.slot_logits(rows, g), v)
                        rows *= WIDTH
                        for out, pair in zip(reversed(cells), (drawn, (g, s)), strict=False):  # in later rounds drawn ones alone
                            out += [(r + which).ravel() for r, which in zip((rows[:FEATURES], rows[FEATURES:]), pair, strict=True)]
                    for total, out in zip(sums, cells, strict=True):
                        total += np.bincount(np.concatenate(out), minlength=len(total))
                cells = ids = history = keys = at = None
                trim()
        *seen, drawn = (x.reshape(-1, BLOCK_ROWS * WIDTH) for x in sums)
        for block in range(len(drawn)):
            pair = [x[block] for x in (*seen, drawn)]
            if any(x.any() for x in pair):
                packed = [b""] * (2 - len(pair)) + [_pack(x) for x in pair]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["block", "seen", "drawn"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all tasks by block; memory is the blocks of this partition."""
    total: dict[int, list[np.ndarray | None]] = {}
    for batch in batches:
        for block, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = total.setdefault(block, [None, None])
            for j, raw in enumerate(pair):
                if raw:
                    x = _unpack(raw)
                    old[j] = x if old[j] is None else old[j] + x
    for block, pair in total.items():
        cells = [b"" if x is None else x.astype(np.float32).tobytes() for x in pair]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["block", "seen", "drawn"])


def moved(weights: np.ndarray, seen: np.ndarray, drawn: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one round, from the corpus's sums."""
    step = np.log((seen + np.float32(DAMPING)) / (drawn + np.float32(DAMPING)))
    return weights + np.float32(rate) * np.clip(step, -MOST, MOST, out=step)


def _scores(shared, frequent=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for doc_ids, held, lens, ids, vocab, tail, known in _cells(batch, "doc_ids held lens ids vocab tail known"):
                ids, lens, vocab = _from_planes(ids), np.array(lens, np.int64), np.frombuffer(vocab, U64)
                c = np.zeros(len(vocab))
                if frequent:
                    hit, count = frequent.value.find(vocab)
                    c[hit] = count
                got = np.frombuffer(known, "<i8").reshape(-1, 2)
                c[got[:, 0]] = got[:, 1]
                group, slot = model.places(vocab, np.frombuffer(tail, np.uint8))
                base = np.log10((c + 1) / (model.train_tokens + model.distinct + 1))
                inside = np.where(slot > 0, 0.0, np.log10((c + 1) / model.mass[group]))
                token = inside[ids]
                history = History(vocab, ids, lens)
                for a in range(0, len(ids), SLICE):
                    part = np.arange(a, min(a + SLICE, len(ids)))
                    i = ids[part]
                    token[part] += model.log_probs(history, part, group[i], slot[i]) / np.log(10)
                first = np.cumsum(lens) - lens
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lens), pa.array(np.add.reduceat((c > 0)[ids].astype(np.int64), first)),
                        pa.array(np.full(len(lens), model.train_tokens)), pa.array(np.add.reduceat(base[ids], first)), pa.array(np.add.reduceat(token, first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def first_model(top: list, sums: list, most_buckets: int = BUCKETS[1]) -> Model:
    """A model without history from the most frequent tokens (c, tail, token) and each class's sums (tail, c, v)."""
    train_tokens, distinct = sum(r.c for r in sums), sum(r.v for r in sums)
    mass = np.ones(WIDTH)
    for r in sums:
        mass[r.tail] += r.c + r.v
    share = mass.copy()
    slots = np.full((WIDTH, WIDTH), -np.inf)
    filled = np.zeros(WIDTH, np.int64)
    named = []
    for r in top:
        if filled[r.tail] < WIDTH - 1:
            filled[r.tail] += 1
            slots[r.tail, filled[r.tail]] = np.log(r.c + 1)
            mass[r.tail] -= r.c + 1
            named.append((r.token, r.tail, filled[r.tail]))
    slots[:, 0] = np.log(mass)
    token, group, slot = np.array(named, np.int64).reshape(-1, 3).T
    token = np.ascontiguousarray(token).view(U64)
    order = np.argsort(token)
    buckets = BUCKETS[0]
    while buckets < most_buckets and buckets * TOKENS_A_BUCKET < train_tokens:
        buckets *= 2
    slots = np.maximum(slots - np.log(share)[:, None], NEVER)
    return Model(
        token[order], group[order], slot[order], mass, np.log(share / share.sum()).astype(np.float32), slots.astype(np.float32),
        train_tokens, distinct, np.zeros((2 * buckets, WIDTH), np.float32),
    )


def score(docs: DataFrame, frequent: int = FREQUENT, most_buckets: int = BUCKETS[1]) -> DataFrame:
    """doc_id, held_out, token counts, base score and model score of every document.

    Tokens with one ``frequent``-th of all training tokens have their counts broadcast; no result depends on it.
    The weights have at most 2 x ``most_buckets`` rows (a power of two) of 192 bytes.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "maxent")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held")).mapInArrow(trimmed(_encode), CHUNKS), "chunks")
    rows = chunks.select("chunk", "vocab", "tail", "counts").mapInArrow(trimmed(_vocabulary), "chunk long, pos int, token long, tail short, n long")
    total = rows.groupBy("token").agg(F.sum("n").alias("c"), F.min("tail").alias("tail"))
    total = scratch.keep(total.filter("c > 0"), "counts")
    sums = total.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # one row a class
    top = total.orderBy(F.desc("c"), "token").limit(NAMED).collect()
    model = first_model(top, sums, most_buckets)
    tasks = max(parts, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    seen = np.zeros_like(model.weights)
    for turn, rate in enumerate(RATES if model.train_tokens else ()):
        shared = spark.sparkContext.broadcast(model)
        counted = chunks.select("doc_ids", "held", "lens", "ids", "vocab", "tail").coalesce(tasks).mapInArrow(trimmed(_count(shared, turn)), SUMS)
        drawn = np.zeros_like(model.weights)
        for r in counted.repartition(parts, "block").mapInArrow(trimmed(_add), SUMS).collect():  # one row a block of weights
            for table, raw in ((seen, r.seen), (drawn, r.drawn)):
                if raw:
                    table[r.block * BLOCK_ROWS : (r.block + 1) * BLOCK_ROWS] = np.frombuffer(raw, np.float32).reshape(-1, WIDTH)
        model = replace(model, weights=moved(model.weights, seen, drawn, rate))
    # counts that are not broadcast go back to the chunks, one row a token and chunk
    common = spark.sparkContext.broadcast(Frequent.of(total, model.train_tokens, frequent))
    others = chunks.select("chunk", "vocab").mapInArrow(trimmed(_others(common)), "chunk long, pos int, token long")
    back = others.join(total.select("token", "c"), "token").select("chunk", "pos", "c")
    known = back.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(_gather), "chunk long, known binary")
    shared = spark.sparkContext.broadcast(model)
    # chunks are the streamed side: their large cells are neither sorted nor held
    joined = chunks.drop("counts").join(known.hint("shuffle_hash"), "chunk", "left").withColumn("known", F.coalesce("known", F.lit(b"")))
    return joined.mapInArrow(trimmed(_scores(shared, common)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk's tokens as one binary cell; a chunk's vocabulary bounds it."""
    from .neardup import groups

    for chunk, (_, pos, c) in groups(batches):
        cell = np.stack([pos.to_numpy().astype("<i8"), c.to_numpy().astype("<i8")], axis=1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([cell], pa.binary())], ["chunk", "known"])
