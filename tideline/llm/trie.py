"""Conversation prefix trie over padded turn-id matrices.

A turn's id is the md5 of its role and text; a conversation is the sequence of
its ids. Equal conversations are one row from the start. The rows are dealt over
range shards of their sequences and read in order. A shard is a padded matrix of
dense turn numbers: ``lexsort`` orders its rows, changes between neighbouring
rows, OR-accumulated over the columns, mark where each depth's nodes start, and
``reduceat`` aggregates members, children, leaves and savings. Columns are taken
64 at a time, so one long conversation pads no others.

Only nodes on a shard's first and last path can go on in other shards. Their
partial sums leave the shard as one row a path (two a shard) and are recombined by
the same functions, a first turn a task; the root is summed from the first depth.

Defined results
* null role or text is empty; rows without conv_id belong to no conversation and are left out
* turns of equal number stand by the md5 of role and text; repeated rows are repeated turns
* c-c%5 is the largest multiple of five not above c, below zero too
* a conversation is held as one row of 20 bytes a turn
* an empty table gives no rows (not even a root); more columns in the input are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .groups import runs
from .store import Scratch
from .textblock import trimmed

COLUMNS = 64
SHARD_TURNS = 1 << 19
KEY_TURNS = 512
BLOCK_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTIAL = ("n", "conv", "size", "children", "leaves", "saved")


@dataclass
class Paths:
    """Sequences of turns with what each contributes at every depth, all depths of all rows in one array a field."""

    lens: np.ndarray
    ids: np.ndarray  # 16 bytes a turn
    n: np.ndarray
    conv: np.ndarray
    size: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    ends: np.ndarray  # place in shas, or -1
    shas: list

    @classmethod
    def of_conversations(cls, lens, ids, size, n, conv, shas) -> Paths:
        lens = np.asarray(lens, np.int64)
        none = np.zeros(int(lens.sum()), np.int64)
        ends = none - 1
        ends[np.cumsum(lens) - 1] = np.arange(len(lens))
        return cls(lens, ids, np.repeat(n, lens), np.repeat(conv, lens), np.asarray(size, np.int64), none, none, none, ends, shas)


@dataclass
class Level:
    """The nodes of one depth, in order."""

    start: np.ndarray  # first row, in sorted order
    parent: np.ndarray  # place among the nodes of the depth above
    sums: dict
    last: np.ndarray  # last row


def dense(ids: np.ndarray) -> np.ndarray:
    """Numbers for 16-byte ids that keep their order."""
    if not len(ids):
        return np.zeros(0, np.int64)
    pair = np.frombuffer(ids.tobytes(), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.concatenate([[False], (pair[order[1:]] != pair[order[:-1]]).any(axis=1)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _matrix(numbers: np.ndarray, first: np.ndarray, lens: np.ndarray, column: int) -> np.ndarray:
    """Columns from ``column`` on of the rows' padded matrix; -1 pads."""
    width = min(COLUMNS, int(lens.max()) - column)
    at = first[:, None] + np.arange(column, column + width)
    inside = np.arange(column, column + width) < lens[:, None]
    return np.where(inside, numbers[np.where(inside, at, 0)], -1)


def levels(p: Paths) -> tuple[np.ndarray, list[Level]]:
    """Order of the rows and the nodes of every depth."""
    numbers, rows = dense(p.ids), len(p.lens)
    first = np.cumsum(p.lens) - p.lens
    order = np.arange(rows)
    changed = np.zeros(rows, bool)  # of the sorted rows: differs from the row before in a column so far
    changed[:1] = True
    out: list[Level] = []
    for column in range(0, int(p.lens.max()), COLUMNS):
        held = np.flatnonzero(p.lens[order] > column)
        run = np.cumsum(changed)[held]
        here = order[held]
        m = _matrix(numbers, first[here], p.lens[here], column)
        sub = np.lexsort((p.lens[here], *m.T[::-1], run))
        here, m = here[sub], m[sub]
        order[held] = here
        alone = np.concatenate([[True], held[1:] != held[:-1] + 1])
        differs = np.concatenate([np.ones((1, m.shape[1]), bool), m[1:] != m[:-1]])
        differs[:, 0] |= changed[held] | alone
        marks = np.logical_or.accumulate(differs, axis=1)
        changed[held] = marks[:, -1]
        for k in range(m.shape[1]):
            depth = column + k
            reach = np.flatnonzero(p.lens[here] > depth)
            starts = np.flatnonzero(marks[reach, k])
            flat = first[here[reach]] + depth
            add = {f: np.add.reduceat(getattr(p, f)[flat], starts) for f in ("n", "children", "leaves", "saved")}
            add |= {"conv": np.minimum.reduceat(p.conv[flat], starts), "ends": np.maximum.reduceat(p.ends[flat], starts), "size": np.maximum.reduceat(p.size[flat], starts)}
            begin = held[reach[starts]]
            end = held[reach[np.concatenate([starts[1:] - 1, [len(reach) - 1]])]]
            parent = np.searchsorted(out[-1].start, begin, side="right") - 1 if out else np.zeros(len(begin), np.int64)
            out.append(Level(begin, parent, add, end))
    return order, out


def _gathered(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Sums over the nodes of each parent; children of one parent are neighbours."""
    out = np.zeros(n, np.int64)
    if len(values):
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        out[parent[begin]] = np.add.reduceat(values, begin)
    return out


def summed(found: list[Level], open_nodes: list[np.ndarray]) -> None:
    """Children, leaves and savings of all nodes, from the deepest up. What hangs below an open node's open children is not added."""
    for depth in range(len(found) - 1, -1, -1):
        s, is_open = found[depth].sums, open_nodes[depth]
        if depth + 1 < len(found):
            below, closed = found[depth + 1], ~open_nodes[depth + 1]
            for f, values in (("children", np.ones(len(below.start), np.int64)), ("leaves", below.sums["leaves"]), ("saved", below.sums["saved"])):
                s[f] = s[f] + _gathered(np.where(closed, values, 0), below.parent, len(is_open))
        s["leaves"] = s["leaves"] + ((s["children"] == 0) & ~is_open)
        s["saved"] = s["saved"] + np.where(is_open, 0, (s["n"] - 1) * s["size"])


def _table(parts: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = max(len(v) for v in parts.values())
    return pa.RecordBatch.from_arrays([pa.array(parts[f.name], f.type) if f.name in parts else pa.nulls(n, f.type) for f in schema], schema=schema)


def _nodes(found: list[Level], shas: list, open_nodes: list[np.ndarray]) -> Iterator[tuple[dict, np.ndarray]]:
    """Columns of the closed nodes of every depth, and the parents' places."""
    for depth, level in enumerate(found):
        shut = np.flatnonzero(~open_nodes[depth])
        if not len(shut):
            continue
        s = {f: v[shut] for f, v in level.sums.items()}
        yield {
            "kind": ["node"] * len(shut), "conv_id": s["conv"], "depth": np.full(len(shut), depth + 1), "n_convs": s["n"], "n_children": s["children"],
            "n_leaves": s["leaves"], "saved_tokens": s["saved"], "ends_sha256": [shas[e] if e >= 0 else NOTHING for e in s["ends"].tolist()],
        }, level.parent[shut]


_LONGS = [(f, pa.int64()) for f in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
_PLACE = [("shard", pa.int64()), ("side", pa.int64())]
_LISTS = [(f"path_{f}", pa.list_(pa.int64())) for f in PARTIAL]
SHARDED = pa.schema([("kind", pa.string()), *_LONGS, ("ends_sha256", pa.string()), *_PLACE, ("path_ids", pa.list_(pa.binary())), *_LISTS, ("path_ends", pa.list_(pa.string()))])
JOINED = pa.schema([("kind", pa.string()), *_LONGS, ("ends_sha256", pa.string()), *_PLACE])


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def shard_rows(p: Paths, shard: int) -> Iterator[pa.RecordBatch]:
    """Closed nodes of a shard, and its first and last path with the partial sums of their open nodes."""
    order, found = levels(p)
    last = len(order) - 1
    ends = [(0, 0)] if last == 0 else [(0, 0), (last, 1)]
    places = [{side: int(np.searchsorted(level.start, row, side="right")) - 1 for row, side in ends if p.lens[order[row]] > d} for d, level in enumerate(found)]
    open_nodes = []
    for level, at in zip(found, places, strict=True):
        mask = np.zeros(len(level.start), bool)
        mask[list(at.values())] = True
        open_nodes.append(mask)
    summed(found, open_nodes)
    for columns, parent in _nodes(found, p.shas, open_nodes):
        d = int(columns["depth"][0]) - 1
        if d:
            above = found[d - 1]
            known = ~open_nodes[d - 1][parent]
            columns["parent_conv_id"] = pa.array(above.sums["conv"][parent], mask=~known)
            side = np.where(parent == places[d - 1].get(0, -1), 0, 1)
            columns["shard"] = pa.array(np.full(len(parent), shard), mask=known)
            columns["side"] = pa.array(side, mask=known)
        yield _table(columns, SHARDED)
    first = np.cumsum(p.lens) - p.lens
    for row, side in ends:
        r = order[row]
        lists = {f: [] for f in (*PARTIAL, "ends")}
        for d in range(int(p.lens[r])):
            k, s = places[d][side], found[d].sums
            own = side == 0 or places[d].get(0) != k  # a node on both paths counts with the first
            for f in PARTIAL:
                lists[f].append(int(s[f][k]) if own or f == "size" else FAR if f == "conv" else 0)
            lists["ends"].append(p.shas[s["ends"][k]] if own and s["ends"][k] >= 0 else None)
        ids = [bytes(x) for x in p.ids[first[r] : first[r] + p.lens[r]]]
        yield _table({"kind": ["path"], "shard": [shard], "side": [side], "path_ids": [ids], "path_ends": [lists.pop("ends")]} | {f"path_{f}": [v] for f, v in lists.items()}, SHARDED)


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def made() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["ids"].combine_chunks()
            raw = np.frombuffer(b"".join(ids.flatten().to_pylist()), np.uint8).reshape(-1, 16)
            numbers = lambda c: t[c].to_numpy()
            lens = np.diff(ids.offsets.to_numpy())
            sizes = t["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            yield from shard_rows(Paths.of_conversations(lens, raw, sizes, numbers("n"), numbers("conv_id"), t["ends_sha256"].to_pylist()), place << 32 | count)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                turns += len(batch.column(0).flatten())
            if turns >= most:
                yield from made()
                count, held, turns = count + 1, [], 0
        if held:
            yield from made()

    return run


def _join_paths(g: pd.DataFrame) -> pd.DataFrame:
    """Nodes that shards share, from the paths that begin with one turn; and which node each path's turns are."""
    flat = lambda c: np.concatenate([np.asarray(x) for x in g[c]])
    lens = np.array([len(x) for x in g["path_ids"]])
    shas = [x for row in g["path_ends"] for x in row]
    ends = np.array([i if x is not None else -1 for i, x in enumerate(shas)])
    ids = np.frombuffer(b"".join(bytes(x) for row in g["path_ids"] for x in row), np.uint8).reshape(-1, 16)
    p = Paths(lens, ids, *(flat(f"path_{f}").astype(np.int64) for f in PARTIAL), ends, shas)
    order, found = levels(p)
    none = [np.zeros(len(level.start), bool) for level in found]
    summed(found, none)
    out = []
    for columns, parent in _nodes(found, shas, none):
        d = int(columns["depth"][0]) - 1
        columns["parent_conv_id"] = found[d - 1].sums["conv"][parent] if d else None
        out.append(pd.DataFrame(columns))
    shard, side = g["shard"].to_numpy(), g["side"].to_numpy()
    for d, level in enumerate(found):
        rows = np.flatnonzero(lens[order] > d)
        node = np.searchsorted(level.start, rows, side="right") - 1
        out.append(pd.DataFrame({"kind": "ref", "shard": shard[order[rows]], "side": side[order[rows]], "depth": d + 1, "conv_id": level.sums["conv"][node]}))
    return pd.concat([x.reindex(columns=JOINED.names) for x in out]).astype({n: "Int64" for n, _ in [*_LONGS, *_PLACE]})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turn ids and text sizes of every conversation with its first h turns taken from the first of its five."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        (conv - F.pmod(conv, F.lit(5))).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"), F.octet_length(text).alias("size"),
    ).filter(F.col("conv_id").isNotNull())
    # one shuffle by the five's base serves both groupings
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("seq"))
    five = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "seq")).alias("convs"))  # at most five
    first = F.coalesce(F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["seq"], F.expr("slice(convs[0].seq, 1, 0)"))
    each = five.select(first.alias("first"), F.explode("convs").alias("c")).select("first", "c.conv_id", "c.seq")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    seq = F.concat(F.slice("first", 1, h), F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0))))
    return each.select("conv_id", seq.alias("seq")).select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.size").alias("sizes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least id and SHA-256 of the joined ids of every sequence, from ordered blocks of ids."""
    out, at, sha = [], None, None
    for new, piece in runs(batches, "key"):
        if new:
            if at:
                out.append((*at, sha.hexdigest()))
            at, sha = [piece.column(0)[0].as_py(), 0, piece.column(2)[0].as_py()], hashlib.sha256()
        for n, ids in zip(piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True):
            sha.update(("," if at[1] else "").encode() + ids.encode())
            at[1] += n
        if len(out) >= 8192:
            yield _ends_batch(out)
            out = []
    if at:
        out.append((*at, sha.hexdigest()))
    if out:
        yield _ends_batch(out)


def _ends_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n", "conv_id", "ends_sha256"])


def sequences(members: DataFrame) -> DataFrame:
    """Distinct sequences: ids, sizes, number and least id of the conversations, hash of all their ids."""
    key = F.md5(F.array_join(F.transform("ids", lambda x: F.hex(x)), ""))
    members = members.withColumn("key", key)
    whole = members.groupBy("key").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    # at most BLOCK_IDS ids of a sequence meet in a row; the rows of a sequence stream by in order
    blocks = members.groupBy("key", F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("joined")
    )
    ends = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(trimmed(_ends), "key string, n long, conv_id long, ends_sha256 string")
    return whole.join(ends, "key").drop("key")


def trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, ids, sizes)."""
    spark = ship(members.sparkSession)
    scratch = Scratch(spark, "trie")
    seqs = scratch.keep(sequences(scratch.keep(members, "members")), "sequences")
    some = F.size("ids") > 0
    ranged = seqs.filter(some).select("ids", "sizes", "n", "conv_id", "ends_sha256").repartitionByRange(F.slice("ids", 1, KEY_TURNS)).sortWithinPartitions("ids")
    sharded = scratch.keep(ranged.mapInArrow(trimmed(_shards(shard_turns)), _spark_schema(SHARDED)), "shards")
    joined = sharded.filter(F.col("kind") == "path").groupBy(F.col("path_ids")[0]).applyInPandas(_join_paths, _spark_schema(JOINED))
    joined = scratch.keep(joined, "joined")  # two paths a shard
    refs = joined.filter(F.col("kind") == "ref").select(F.col("shard").alias("of"), F.col("side").alias("of_side"), F.col("depth").alias("of_depth"), F.col("conv_id").alias("of_conv"))
    nodes = sharded.filter(F.col("kind") == "node")
    met = (F.col("shard") == F.col("of")) & (F.col("side") == F.col("of_side")) & (F.col("depth") == F.col("of_depth") + 1)
    nodes = nodes.join(refs, met, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_conv"))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    nodes = nodes.select(*columns).unionByName(joined.filter(F.col("kind") == "node").select(*columns))
    nodes = scratch.keep(nodes, "nodes")
    top = nodes.filter(F.col("depth") == 1).select("conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
    bare = seqs.filter(~some).select("conv_id", F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child"), F.col("ends_sha256").alias("ends"))
    root = top.unionByName(bare).agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(NOTHING)).alias("ends_sha256"),
    ).filter(F.col("n_convs") > 0)
    found = root.select("conv_id").first()
    if not found:
        return root
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(found.conv_id)).otherwise(F.col("parent_conv_id")))
    return nodes.unionByName(root)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return trie(rebuilt(conversations), shard_turns)

#: The same for whole tables in DuckDB, by grouping all prefixes. A negative conv_id is none of the test tables' cases.
SQL = """
WITH crc AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(CASE WHEN b.seq IS NULL THEN [] ELSE b.seq[1:h] END, o.seq[h + 1:]) AS seq
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = crc.base),
members AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT seq[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d), '')) AS ends
  FROM members GROUP BY ALL),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
own_sums AS (
  SELECT path, d, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d > 0 THEN (n - 1) * strlen(path[d].t) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (path)),
above AS (SELECT path, leaf, saved, unnest(range(d + 1)) AS a FROM own_sums),
subtree AS (SELECT path[1:a] AS path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k, 0) AS n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN subtree USING (path) LEFT JOIN kids USING (path) LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[1:v.d - 1]"""
