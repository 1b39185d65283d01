"""Document fingerprints by prefix polynomial hashes.

``PrefixHashes`` holds, for every position of a text, the polynomial of the bytes
before it under two prime moduli. The difference of two entries, divided by the
base's power at the first, is the hash of the span between them, so any two spans
of any two texts are compared in constant time, and the longest common extension
of two positions is found by binary search.

A fingerprint is the prefix array at positions that the text itself chooses: the
ends of those 8-byte windows whose hash has enough zero bits, each distinct
window once, 12 to 24 of them expected whatever the length, and the end. It
answers the equality of any span between two such positions, and the positions
of a longer text's coarser choice are among those of a shorter one's. ``likeness``
walks over the spans of one fingerprint, looks each up in the other and extends
it by binary search; the share of bytes so covered is the result.

Documents are dealt over range shards by descending id, so that a document and
its next one stream by in one task; the last one of a shard meets the first of
the next shard in a second, small step. Texts are shuffled once and held two at a
time, hashes a segment at a time.

Defined results
* null text counts as an empty one; two empty texts are alike (1), an empty and another are not (0)
* a null doc_id stands last; rows of one id stand by a hash of their texts; repeated rows follow each other
* a single row is its own next document; an empty table gives no rows
* more columns in the input are ignored
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .store import Scratch
from .textblock import arrow_bytes, mix, trimmed

U64 = np.uint64
MODULI = (2147483647, 2147483629)
BASES = (1145141919, 998244353)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, MODULI, strict=True))
WINDOW = 8
SPANS = 12
SEGMENT = 1 << 18

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")]


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), modulus)) % U64(modulus)])
    return out[:n]


_N = SEGMENT + WINDOW + 1
_UP = [_powers(b, p, _N) for b, p in zip(BASES, MODULI, strict=True)]
_DOWN = [_powers(b, p, _N) for b, p in zip(INVERSES, MODULI, strict=True)]


class PrefixHashes:
    """Prefix arrays of a text of any length; two numbers a byte."""

    def __init__(self, data: np.ndarray | bytes):
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        self.n = len(data)
        self.at = np.zeros((2, self.n + 1), U64)
        codes = data.astype(U64) + U64(1)
        for k, p in enumerate(MODULI):
            for a in range(0, self.n, SEGMENT):
                b = min(a + SEGMENT, self.n)
                part = np.cumsum(codes[a:b] * _UP[k][: b - a] % U64(p)) % U64(p)
                self.at[k, a + 1 : b + 1] = (self.at[k, a] + part * U64(pow(BASES[k], a, p))) % U64(p)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of bytes i to j: equal for equal spans, wherever they are."""
        return tuple((int(self.at[k, j]) - int(self.at[k, i])) * pow(INVERSES[k], i, p) % p for k, p in enumerate(MODULI))

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common prefix of this text from i and the other from j."""
        return _longest(min(self.n - i, other.n - j), lambda m: self.span(i, i + m) == other.span(j, j + m))


def _longest(most: int, same) -> int:
    """Greatest m of 0 to most with same(m), which holds for all smaller ones."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        if same(mid):
            low = mid
        else:
            most = mid - 1
    return low


class Fingerprint:
    """Chosen positions, how many zero bits chose each, and the prefix hashes there; the last is the text's end."""

    def __init__(self, ends: list[int], levels: list[int], values: list[tuple[int, int]], least: int):
        self.ends, self.levels, self.values, self.least = ends, levels, values, least

    @property
    def size(self) -> int:
        return self.ends[-1]

    def __str__(self) -> str:
        return f"{self.least:x};" + ";".join(f"{e:x},{lv:x},{v[0] << 31 | v[1]:x}" for e, lv, v in zip(self.ends, self.levels, self.values, strict=True))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        least, *rows = text.split(";")
        cells = [[int(x, 16) for x in r.split(",")] for r in rows]
        return cls([c[0] for c in cells], [c[1] for c in cells], [(c[2] >> 31, c[2] & 0x7FFFFFFF) for c in cells], int(least, 16))

    def spans(self, least: int) -> tuple[list[int], list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Positions of a choice at least as coarse, from 0 to the end, length and hash of the spans between, prefix hashes."""
        chosen = [(0, (0, 0)), *((e, v) for e, lv, v in zip(self.ends[:-1], self.levels, self.values, strict=False) if lv >= least)]
        if chosen[-1][0] != self.size:
            chosen.append((self.size, self.values[-1]))
        at, values = [c[0] for c in chosen], [c[1] for c in chosen]
        return at, [span(at, values, i, i + 1) for i in range(len(at) - 1)], values


def span(at: list[int], values: list[tuple[int, int]], i: int, j: int) -> tuple[int, int, int]:
    """Length and hash of the span from the i-th position to the j-th."""
    a, b = ((values[j][k] - values[i][k]) * pow(INVERSES[k], at[i], p) % p for k, p in enumerate(MODULI))
    return at[j] - at[i], a, b


def fingerprint(data: np.ndarray) -> Fingerprint:
    n = len(data)
    least = max(0, (n // SPANS).bit_length() - 1)
    ends, levels, values, seen = [], [], [], set()
    before, power = [0, 0], [1, 1]  # prefix hashes and the bases' powers at the segment's start
    for a in range(0, n, SEGMENT):
        b = min(a + SEGMENT, n)
        back = min(a, WINDOW - 1)  # windows reach into the segment before
        local = PrefixHashes(data[a - back : b])
        size = b - a + back
        if size >= WINDOW:
            p = U64(MODULI[0])
            h = mix((local.at[0, WINDOW:] + p - local.at[0, :-WINDOW]) % p * _DOWN[0][: size - WINDOW + 1] % p)
            hits = np.flatnonzero(h & U64((1 << least) - 1) == 0)
            for at in hits[np.sort(np.unique(h[hits], return_index=True)[1])].tolist():
                if (key := int(h[at])) not in seen:
                    seen.add(key)
                    ends.append(a - back + at + WINDOW)
                    levels.append(min(63, (key & -key).bit_length() - 1) if key else 63)
                    there = []
                    for k, m in enumerate(MODULI):
                        inside = (int(local.at[k, at + WINDOW]) - int(local.at[k, back])) * pow(INVERSES[k], back, m)
                        there.append((before[k] + power[k] * inside) % m)
                    values.append(tuple(there))
        for k, m in enumerate(MODULI):
            inside = (int(local.at[k, size]) - int(local.at[k, back])) * pow(INVERSES[k], back, m)
            before[k] = (before[k] + power[k] * inside) % m
            power[k] = power[k] * pow(BASES[k], b - a, m) % m
    if not ends or ends[-1] != n:
        ends.append(n)
        levels.append(0)
        values.append(tuple(before))
    return Fingerprint(ends, levels, values, least)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of both texts' bytes in common spans that follow each other in both; from the fingerprints alone."""
    if a.size == b.size and a.values[-1] == b.values[-1]:
        return 1.0
    if not a.size or not b.size:
        return 0.0
    least = max(a.least, b.least)
    at, spans, values = a.spans(least)
    other_at, other_spans, other_values = b.spans(least)
    where: dict[tuple[int, int, int], list[int]] = {}
    for j, s in enumerate(other_spans):
        where.setdefault(s, []).append(j)
    i = free = common = 0
    while i < len(spans):
        found = where.get(spans[i], [])
        j = next(iter(found[bisect_left(found, free) :]), None)
        if j is None:
            i += 1
            continue
        same = lambda m, i=i, j=j: not m or span(at, values, i, i + m) == span(other_at, other_values, j, j + m)
        m = max(1, _longest(min(len(spans) - i, len(other_spans) - j), same))
        common += at[i + m] - at[i]
        i, free = i + m, j + m
    return 2 * common / (a.size + b.size)


def chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((data[a : a + SEGMENT] & 0xC0) != 0x80)) for a in range(0, len(data), SEGMENT))


def offset(data: np.ndarray, n: int) -> int:
    """Bytes of the first n code points (all if fewer)."""
    for a in range(0, len(data), SEGMENT):
        starts = np.flatnonzero((data[a : a + SEGMENT] & 0xC0) != 0x80)
        if n < len(starts):
            return a + int(starts[n])
        n -= len(starts)
    return len(data)


class _Doc:
    def __init__(self, doc_id: int | None, data: np.ndarray):
        self.doc_id, self.data, self.chars = doc_id, data, chars(data)
        self.print = fingerprint(data)

    def row(self, follower: _Doc) -> tuple:
        third = self.chars // 3
        kept, more = self.data[: offset(self.data, self.chars - third)], follower.data[: offset(follower.data, third)]
        sha = hashlib.sha256(kept)
        sha.update(more)
        edited = fingerprint(np.concatenate([kept, more]))
        return self.doc_id, self.chars, sha.hexdigest(), str(self.print), str(edited), likeness(self.print, edited), likeness(self.print, follower.print)

    def text(self) -> str:
        return self.data.tobytes().decode("utf-8", "replace")


def _docs(ids: pa.Array, texts: pa.Array) -> Iterator[_Doc]:
    data, offsets = arrow_bytes(texts)
    for i, doc_id in enumerate(ids.to_pylist()):
        yield _Doc(doc_id, np.ascontiguousarray(data[offsets[i] : offsets[i + 1]]))


EDGES = f"{SCHEMA}, shard int, edge string, text string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents but the shard's last; the first and the last as edges with their texts."""
    shard, last = TaskContext.get().partitionId(), None
    kinds = [*FIELDS, ("shard", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
    edge = lambda doc, kind: (doc.doc_id, *[None] * (len(FIELDS) - 1), shard, kind, doc.text())
    for batch in batches:
        rows = []
        for doc in _docs(batch.column(0), batch.column(1)):
            rows.append((*last.row(doc), shard, None, None) if last else edge(doc, "first"))
            last = doc
        if rows:
            yield batch_of(rows)
    if last:
        yield batch_of([edge(last, "last")])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [a.row(b) for a, b in zip(_docs(batch.column(0), batch.column(1)), _docs(batch.column(2), batch.column(3)), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "prints")
    # the text's hash and the row's place let equal ids lie in several shards
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), "hash", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(trimmed(_stream), EDGES)
    rows = scratch.keep(rows, "streamed", "zstd")  # hexadecimal digits take half their bytes
    shards = [r.shard for r in rows.filter(F.col("edge") == "first").select("shard").orderBy("shard").collect()]  # one a partition
    follows = spark.createDataFrame(list(zip(shards, shards[1:] + shards[:1], strict=True)), "shard int, other int")
    last = rows.filter(F.col("edge") == "last").select("shard", "doc_id", "text").join(F.broadcast(follows), "shard")
    first = rows.filter(F.col("edge") == "first").select(F.col("shard").alias("other"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    joined = last.join(first, "other").select("doc_id", "text", "next_id", "next_text").mapInArrow(trimmed(_join_edges), SCHEMA)
    return rows.filter(F.col("edge").isNull()).select(*(n for n, _ in FIELDS)).unionByName(joined)
