"""Hierarchical packing of documents into windows of several sizes.

Each document's ids are cut into whole 4096-token windows and one remainder. A
remainder is routed to the smallest context tier that holds it (512, 1024, 2048
or 4096), where it opens a window of that size. Longer tiers are packed first;
the gap of a window is filled from shorter remainders, largest that fits first,
and the last bit with a piece cut from another remainder. What is left when the
pool runs dry is split at powers of two, which need no padding. Windows are
then dealt to step groups of equal token counts, heaviest first.

A task packs its own documents in blocks of bounded token count as it streams
over them: nothing is shuffled, and a lost task is repeated alone.

Defined results
* null or empty text: one piece with the end id alone
* repeated rows and ids are packed as separate documents
* an empty table gives no pieces; more columns in the input are ignored
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..plans.ship import ship
from .textblock import arrow_bytes, slices, trimmed
from .tokens import word_tokenizer

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, step_group long"
)

Piece = tuple[int, int, int]  # document, start, length


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Windows of pieces; every token of every document lies in one piece."""
    window = tiers[-1]
    done: list[list[Piece]] = []
    pool: list[tuple[int, int, int]] = []  # remainder, document, start; ascending
    for doc, n in enumerate(lengths):
        whole = n // window * window
        done += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    while pool:
        r, doc, at = pool.pop()
        size = next(t for t in tiers if t >= r)
        items = [(doc, at, r)]
        gap = size - r
        while gap and pool:
            k = bisect_right(pool, (gap, len(lengths), 0))
            if k:
                n, doc, at = pool.pop(k - 1)
            else:
                n, doc, at = pool.pop(0)
                insort(pool, (n - gap, doc, at + gap))
                n = gap
            items.append((doc, at, n))
            gap -= n
        done += split_at_powers(items) if gap else [items]
    return done


def split_at_powers(items: list[Piece]) -> list[list[Piece]]:
    """A part-filled window as windows whose sizes are powers of two."""
    left = sum(n for _, _, n in items)
    out: list[list[Piece]] = []
    queue = items[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        part: list[Piece] = []
        while want:
            doc, at, n = queue.pop()
            take = min(n, want)
            part.append((doc, at, take))
            if n > take:
                queue.append((doc, at + take, n - take))
            want -= take
        out.append(part)
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: about ``step_tokens`` a group, heaviest window first to the lightest group."""
    import heapq

    n = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


class _Block:
    """Documents of one task until they are packed: their ids in a row, and how many each has."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.base = task << 40
        self.windows = self.groups = 0
        self.tiers, self.step_tokens = tiers, step_tokens
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list[pa.Array] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.tokens += len(ids)

    def flush(self) -> pa.RecordBatch:
        lengths = np.concatenate(self.lengths)
        first = np.cumsum(lengths) - lengths
        raw = memoryview(np.concatenate(self.ids).astype("<u4").view(np.uint8))
        windows = pack_block(lengths.tolist(), self.tiers)
        doc, start, n = np.array([p for w in windows for p in w], np.int64).T
        held = np.array([len(w) for w in windows])
        window = np.repeat(np.arange(len(windows)), held)
        before = np.cumsum(n) - n
        offset = before - before[np.cumsum(held) - held][window]
        sizes = np.add.reduceat(n, np.cumsum(held) - held)
        tier = np.array(self.tiers)[np.searchsorted(self.tiers, sizes)]
        groups = np.array(step_groups(sizes.tolist(), self.step_tokens))
        at = (first[doc] + start) * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + n * 4).tolist(), strict=True)]
        columns = [
            pa.concat_arrays(self.doc_ids).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), pa.array(lengths[doc]),
            pa.array(self.base + self.windows + window), pa.array(offset), pa.array(sizes[window]), pa.array(tier[window].astype(np.int32)),
            pa.array(self.base + self.groups + groups[window]),
        ]
        self.windows += len(windows)
        self.groups += int(groups.max()) + 1
        self.clear()
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    block_tokens: int = 2_000_000,
    step_tokens: int = 16 * WINDOW,
) -> DataFrame:
    """Pieces of all documents: which ids lie where in which window."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        block = _Block(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64())
            data, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets):
                ids, lengths = tokenizer.encode([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], end_id)
                block.add(doc_ids.slice(a, b - a), ids, lengths)
                if block.tokens >= block_tokens:
                    yield block.flush()
        if block.tokens:
            yield block.flush()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
