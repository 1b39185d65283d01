"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark passages are cut into overlapping segments. If a region of a document
is within k edits of a segment of m characters, the two share at least
m - q + 1 - k*q of the segment's q-grams, and these lie on diagonals (document
position minus segment position) that differ by at most 2k. So q-grams common to
a document and a segment are counted in diagonal bands of 2(2k + 1) diagonals
that overlap by half; bands that reach the bound are verified by an alignment
that fills only a band of the edit-distance table. A q-gram that stands more than
once in a segment is counted at its first place alone: an edit still spoils at most q
of the places counted. One in more than ``POPULAR`` segments is not counted, as long as
the bound stays positive. Both lower the bound, so neither runs of one character nor
phrases that all passages share make long lists of hits. A segment with too few
q-grams for its edits is held to as many edits as they bear, and searched for as it
is where they bear none.

Items too short for that are found whole, between characters that are no letters or
digits, with the edits of ``SHORT_EDITS``, by the same lemma with the shorter q-grams
given there.

Texts are compared as UTF-8 bytes with A-Z and accented Latin capitals lowered and
white space runs as one space. The benchmark is a stated query set: it is taken in blocks of at most
``BLOCK_BYTES``, each broadcast and held against all rows. Every document is
searched in full and alone, so no shuffle is needed and no row count matters.

Defined results
* null or empty texts, on either side, match nothing
* a passage of less than ``MIN_BYTES`` bytes after normalising is found as a whole: with one
  edit from 8 bytes on and two from 20 on, unedited below 8 or where its q-grams repeat; one of
  less than ``shortest`` bytes is no evidence and is not searched
* a copied part of a longer passage is certain to be found from 1.5 segments on, so ``segment``
  sets the shortest quote: 40 finds all of 60 bytes
* repeated rows are each reported; a passage that occurs several times in a
  document is reported once for each (document, item), at its best place
* empty tables give no rows; more columns in the inputs are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .textblock import LOWER, SPACE, U64, arrow_bytes, mix, slices, trimmed

Q = 12
SEGMENT = 80
EDIT_RATE = 0.06
MIN_BYTES = 24
SHORTEST = 8
SHORT_EDITS = ((8, 4, 1), (12, 6, 1), (20, 6, 2))  # from so many bytes: q, edits; q * (edits + 1) bytes or more
POPULAR = 64
PART = 1 << 20  # normalised bytes searched at a time; parts overlap by two segments
MOST_HITS = 1 << 21  # (position, segment) pairs held at a time
BLOCK_BYTES = 4_000_000
TABLE_BITS = 22
FOUND = "doc_id long, item_id long, start long, end long, edits int, segment_bytes int"


def normalise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with single spaces, and each one's place in ``data``."""
    space = SPACE[data]
    keep = ~space
    if len(keep):
        keep[1:] |= ~space[:-1]
    where = np.flatnonzero(keep).astype(np.int32 if len(keep) < 1 << 31 else np.int64)
    out = LOWER[data[where]]
    out[space[where]] = 0x20
    if len(out) > 1:  # accented Latin capitals: 0xC3 0x80-0x9E, but for the multiplication sign
        second = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][second] += 0x20
    return out, where


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q = 12 (or 8 and less) bytes at each position."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    if q <= 8:
        data = np.append(data, np.zeros(8, np.uint8))
        return (np.ndarray((n,), "<u8", data, strides=(1,)) & U64(256**q - 1)) * U64(0x9E3779B97F4A7C15)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return (words[:n] * U64(0x9E3779B97F4A7C15)) ^ ((words[4 : 4 + n] + U64(0x632BE59BD9B4E019)) * U64(0xD6E8FEB86659FD93))


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for m bytes: the rate, as far as the lemma's bound stays positive."""
    return max(0, min(int(m * rate), (m - Q) // Q))


@dataclass
class Segments:
    """Distinct segments of one block of the benchmark, the items that hold each, and their q-grams."""

    items: list[list[int]]
    text: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    gram: np.ndarray  # distinct, ascending
    first: np.ndarray  # postings of gram i: first[i]:first[i + 1]
    post_segment: np.ndarray
    post_at: np.ndarray
    table: np.ndarray  # may a hash be among them?
    exact: list[tuple[bytes, bool]]  # searched as they are; whether between non-letters only
    exact_items: list[list[int]]
    q: int = Q
    segment: int = SEGMENT
    short: list[Segments] = field(default_factory=list)  # whole short items, by q


def build(items: list[tuple[int, bytes]], shortest: int = SHORTEST, segment: int = SEGMENT, rate: float = EDIT_RATE) -> Segments:
    if segment < MIN_BYTES:
        raise ValueError(f"a segment has {MIN_BYTES} bytes or more")
    held: dict[bytes, dict[int, None]] = {}
    exact: dict[tuple[bytes, bool], dict[int, None]] = {}
    short: dict[int, dict[bytes, dict[int, None]]] = {}
    for item_id, raw in items:
        norm = normalise(np.frombuffer(raw, np.uint8))[0].tobytes().strip()
        if len(norm) < MIN_BYTES:
            if len(norm) >= shortest:
                exact.setdefault((norm, True), {})[item_id] = None
                if len(norm) >= SHORT_EDITS[0][0]:
                    short.setdefault(_short(norm)[0], {}).setdefault(norm, {})[item_id] = None
            continue
        last = max(0, len(norm) - segment)
        for at in sorted({*range(0, last, segment // 2), last}):
            held.setdefault(norm[at : at + segment], {})[item_id] = None
    out = _index(held, np.array([budget(len(t), rate) for t in held], np.int64), Q, segment)
    for i in np.flatnonzero(out.need <= 0):
        exact.setdefault((out.text[i], False), {}).update(held[out.text[i]])
    out.exact, out.exact_items = list(exact), [list(x) for x in exact.values()]
    out.short = [_index(some, np.array([_short(t)[1] for t in some], np.int64), q, segment) for q, some in short.items()]
    return out


def _short(norm: bytes) -> tuple[int, int]:
    """q and edits of a short item."""
    return next((q, edits) for least, q, edits in reversed(SHORT_EDITS) if len(norm) >= least)


def _index(held: dict[bytes, dict[int, None]], edits: np.ndarray, q: int, size: int) -> Segments:
    """q-grams of texts and the bounds they bear; ``need`` is 0 or less where they bear no search."""
    text = list(held)
    hashes = [grams(np.frombuffer(t, np.uint8), q) for t in text]
    gram = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    segment = np.repeat(np.arange(len(text)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.lexsort((at, segment, gram))
    gram, segment, at = gram[order], segment[order], at[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = gram[1:] != gram[:-1]
    again = np.zeros(len(gram), bool)  # at an earlier place of its segment too
    again[1:] = ~fresh[1:] & (segment[1:] == segment[:-1])
    often = np.diff(np.append(np.flatnonzero(fresh), len(gram)))[np.cumsum(fresh) - 1] > POPULAR
    kept = lambda drop: np.bincount(segment[~drop], minlength=len(text))
    rare = kept(again | often) > edits * q
    drop = again | (often & rare[segment])
    left = kept(drop)
    edits = np.minimum(edits, np.maximum(left - 1, 0) // q)
    need = np.where((edits > 0) | (left > q), left - edits * q, 0)
    drop |= need[segment] <= 0
    gram, segment, at = gram[~drop], segment[~drop], at[~drop]
    distinct, first = np.unique(gram, return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(distinct)] = True
    return Segments([list(held[t]) for t in text], text, edits, need, distinct, np.append(first, len(gram)), segment, at, table, [], [], q, size)


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - TABLE_BITS)


def align(pattern: np.ndarray, region: np.ndarray, shift: int, half: int, limit: int) -> tuple[int, int] | None:
    """Fewest edits of ``pattern`` against any part of ``region``, and where that part ends.

    Only cells within ``half`` of the diagonal that starts at ``shift`` are filled.
    """
    width = 2 * half + 1
    far = limit + 1
    lane = np.arange(width)
    column = shift - half + lane  # region position before row 1's character
    row = np.where((column >= 0) & (column <= len(region)), 0, far)
    padded = np.full(len(region) + 2 * (width + len(pattern)) + 2, 256, np.int64)
    base = width + len(pattern)
    padded[base : base + len(region)] = region
    for i, c in enumerate(pattern):
        # lane j of this row stands at region position column[j] + i + 1
        here = padded[base + column[0] + i : base + column[0] + i + width]
        step = row + (here != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        place = column + i + 1
        step[(place < 0) | (place > len(region))] = far
        row = np.minimum(np.minimum.accumulate(step - lane) + lane, far)
        row[(place < 0) | (place > len(region))] = far
        if row.min() > limit:
            return None
    best = int(row.argmin())
    return int(row[best]), int(column[best] + len(pattern))


def _hits(index: Segments, norm: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of known q-grams that lie in one text, and the q-grams' numbers, a bounded run at a time.

    Runs overlap by more than the longest region that is looked for.
    """
    for start in range(0, max(1, len(norm)), PART - 2 * index.segment):
        g = grams(norm[start : start + PART], index.q)
        at = np.flatnonzero(index.table[_slot(g)])
        k = np.minimum(np.searchsorted(index.gram, g[at]), len(index.gram) - 1)
        hit = index.gram[k] == g[at]
        at, k = at[hit] + start, k[hit]
        inside = at + index.q <= bounds[np.searchsorted(bounds, at, side="right")] if len(at) else np.zeros(0, bool)
        todo = [(at[inside], k[inside])]
        while todo:
            at, k = todo.pop()
            if not len(at):
                continue
            total = int((index.first[k + 1] - index.first[k]).sum())
            if total > MOST_HITS and at[-1] - at[0] > 8 * index.segment:
                middle = (int(at[0]) + int(at[-1])) // 2
                left, right = at < middle + 2 * index.segment, at >= middle
                todo += [(at[right], k[right]), (at[left], k[left])]
            else:
                yield at, k


def _regions(index: Segments, norm: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, segment, first byte, end byte, edits) of verified regions, in normalised bytes."""
    known: dict[tuple, tuple[int, int, int] | None] = {}
    for r, seg, first, last, places in _bands(index, norm, bounds):
        text, edits = index.text[seg], int(index.edits[seg])
        low = max(int(bounds[r]), first - 2 * edits - 1)
        high = min(int(bounds[r + 1]), last + len(text) + 2 * edits + 1)
        region = norm[low:high].tobytes()
        key = seg, region, first - low, last - first
        if key not in known:  # phrases recur: each region is aligned once
            if len(known) >= 20_000:
                known.clear()
            known[key] = None
            exact = region.find(text)
            if exact >= 0:
                known[key] = exact, exact + len(text), 0
            elif len(np.unique(places)) >= index.need[seg]:
                codes = np.frombuffer(region, np.uint8).astype(np.int64)
                got = align(np.frombuffer(text, np.uint8).astype(np.int64), codes, (first + last) // 2 - low, last - first + 2 * edits + 1, edits)
                if got and got[1] > 0:
                    known[key] = max(0, got[1] - len(text)), got[1], got[0]
        if known[key]:
            begin, end, cost = known[key]
            yield r, seg, low + begin, low + end, cost


def _bands(index: Segments, norm: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(row, segment, least and most diagonal, places in the segment) of bands that reach the bound."""
    for at, k in _hits(index, norm, bounds):
        n = index.first[k + 1] - index.first[k]
        post = np.repeat(index.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        segment, diagonal = index.post_segment[post], at - index.post_at[post]
        enough = np.bincount(segment, minlength=len(index.need))[segment] >= index.need[segment]
        at, post, segment, diagonal = at[enough], post[enough], segment[enough], diagonal[enough]
        row = np.searchsorted(bounds, at, side="right") - 1
        band = diagonal // (2 * index.edits[segment] + 1)
        for shift in (0, 1):  # a band holds the diagonals of two neighbours, so bands overlap by half
            key = np.stack([row, segment, (band + shift) // 2])
            order = np.lexsort(key[::-1])
            s = key[:, order]
            head = np.flatnonzero(np.concatenate([[True], (s[:, 1:] != s[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(order)))
            near = np.flatnonzero(count >= index.need[s[1, head]])
            if not len(near):
                continue
            least, most = np.minimum.reduceat(diagonal[order], head), np.maximum.reduceat(diagonal[order], head)
            for j in near:
                r, seg, first, last = int(s[0, head[j]]), int(s[1, head[j]]), int(least[j]), int(most[j])
                yield r, seg, first, last, index.post_at[post[order[head[j] : head[j] + count[j]]]]


def within(a: bytes, b: bytes, limit: int) -> int | None:
    """Edits between two whole short texts, if ``limit`` or less; a band of the table is filled."""
    if abs(len(a) - len(b)) > limit:
        return None
    row = {j: j for j in range(limit + 1)}
    for i, c in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = row.get(j, limit) + 1
            if j:
                best = min(best, row.get(j - 1, limit + 1) + (c != b[j - 1]), new.get(j - 1, limit) + 1)
            new[j] = best
        row = new
    return row[len(b)] if row[len(b)] <= limit else None


_LETTER = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])


def _whole(index: Segments, norm: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item text, first byte, end byte, edits) of short items between characters that are no letters or digits."""
    letter = _LETTER[norm]
    known: dict[tuple[int, bytes], int | None] = {}
    for r, seg, first, last, _ in _bands(index, norm, bounds):
        text, edits = index.text[seg], int(index.edits[seg])
        low, high = int(bounds[r]), int(bounds[r + 1])
        for start in range(max(low, first - edits), min(high, last + edits + 1)):
            if start > low and letter[start - 1]:
                continue
            for end in range(start + len(text) - edits, min(high, start + len(text) + edits) + 1):
                if end < high and letter[end]:
                    continue
                key = seg, norm[start:end].tobytes()
                if key not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    known[key] = within(text, key[1], edits)
                if known[key] is not None:
                    yield r, seg, start, end, known[key]


def _as_they_are(index: Segments, norm: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, number, first byte) of texts searched exactly, the first in each row."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, (text, _) in enumerate(index.exact):
        automaton.add_word(text.decode("latin-1"), [*automaton.get(text.decode("latin-1"), []), i])
    automaton.make_automaton()
    for r in range(len(bounds) - 1):
        text = norm[bounds[r] : bounds[r + 1]].tobytes()
        seen: set[int] = set()
        for end, which in automaton.iter(text.decode("latin-1")):
            for i in which:
                if i in seen:
                    continue
                first = end + 1 - len(index.exact[i][0])
                whole = (first == 0 or not _LETTER[text[first - 1]]) and (end + 1 == len(text) or not _LETTER[text[end + 1]])
                if whole or not index.exact[i][1]:
                    seen.add(i)
                    yield r, i, int(bounds[r]) + first
            if len(seen) == len(index.exact):
                break


def search(index: Segments, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, first byte, end byte, edits, segment length) of verified regions."""
    norm, where = normalise(data)
    bounds = np.searchsorted(where, offsets)
    if len(index.gram):
        for r, seg, first, end, edits in _regions(index, norm, bounds):
            for item in index.items[seg]:
                yield r, item, int(where[first] - offsets[r]), int(where[end - 1] + 1 - offsets[r]), edits, len(index.text[seg])
    for short in index.short:
        if len(short.gram):
            for r, seg, first, end, edits in _whole(short, norm, bounds):
                for item in short.items[seg]:
                    yield r, item, int(where[first] - offsets[r]), int(where[end - 1] + 1 - offsets[r]), edits, len(short.text[seg])
    if index.exact:
        for r, i, first in _as_they_are(index, norm, bounds):
            size = len(index.exact[i][0])
            for item in index.exact_items[i]:
                yield r, item, int(where[first] - offsets[r]), int(where[first + size - 1] + 1 - offsets[r]), 0, size


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's passages, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # an item longer than a block is taken in overlapping parts, so a block holds twice its bytes at most
    step, keep = max(1, block_bytes // 8), 4 * segment
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(step)), lambda at: F.substr(F.col("text"), at + 1, F.lit(step + keep)))
    parts = items.select("item_id", F.posexplode(cut).alias("part", "text"))
    n = max(1, -(-total // block_bytes) * 2 if total > block_bytes else 1)
    for i in range(n):
        part = items if n == 1 else parts.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(n)) == i)
        yield [(r.item_id, r.text.encode()) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, *, segment: int = SEGMENT, edit_rate: float = EDIT_RATE, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage.

    Quotes of 1.5 ``segment`` bytes are certain to be found, with ``edit_rate`` edits a byte as far as the lemma
    bears them; items of less than ``shortest`` bytes are not searched.
    """
    spark = ship(docs.sparkSession)
    parts = []
    for items in blocks(benchmark, segment=segment):
        shared = spark.sparkContext.broadcast(build(items, shortest, segment, edit_rate))  # at most BLOCK_BYTES of passages

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                data, offsets = arrow_bytes(batch.column(1))
                rows = []
                for a, b in slices(offsets):
                    base = offsets[a]
                    best: dict[tuple[int, int], tuple] = {}
                    part = data[base : offsets[b]]
                    for r, item, start, end, edits, size in search(shared.value, part, offsets[a : b + 1] - base):
                        old = best.get((r, item))
                        if old is None or (edits, start) < (old[2], old[0]):
                            best[r, item] = (start, end, edits, size)
                    for (r, item), (start, end, edits, size) in best.items():
                        text = data[offsets[a + r] : offsets[a + r + 1]]
                        head = (text & 0xC0) != 0x80  # first bytes of characters
                        rows.append((ids[a + r].as_py(), item, int(head[:start].sum()), int(head[:end].sum()), edits, size))
                if rows:
                    types = [pa.int64()] * 4 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), FOUND))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, *, segment: int = SEGMENT, edit_rate: float = EDIT_RATE, shortest: int = SHORTEST) -> DataFrame:
    """The documents that hold no passage of the benchmark, unchanged; parameters as in ``find``."""
    spark = ship(docs.sparkSession)
    out = docs
    for items in blocks(benchmark, segment=segment):
        shared = spark.sparkContext.broadcast(build(items, shortest, segment, edit_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = arrow_bytes(batch.column(batch.schema.get_field_index("text")))
                keep = np.ones(batch.num_rows, bool)
                for a, b in slices(offsets):
                    base = offsets[a]
                    for r, *_ in search(shared.value, data[base : offsets[b]], offsets[a : b + 1] - base):
                        keep[a + r] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(trimmed(run), out.schema)
    return out
