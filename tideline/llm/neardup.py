"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its k-word shingles. Equal sets are one vertex. Every
vertex gets min-wise tokens of ``AXES`` independent coordinates. Each of ``TREES``
trees branches first on two tokens of its own: a vertex goes into the node of the
pair. Nodes above ``NODE_CAP`` members branch on, on ``BRANCHES`` further tokens
chosen from the node's path. Inside a node of any size up to ``NODE_CAP`` all
members are compared by sketches, and the vertices that may be alike are joined
into clusters. A pair at similarity 0.8 shares none of the 12 first nodes with
probability 0.36^12 = 5e-6, one at 0.3 shares one with 0.7, and it is left out by the
64-token sketches at the 0.5 mark with probability below 1e-7.

Clusters are then resolved on full sets, read again from the texts: from each
member in turn, all members still unreached are compared, so the links of a
component are found without listing pairs. A cluster above ``CLUSTER_CAP`` is
resolved node by node instead. Nodes that stay large at the end of branching are
resolved exactly. All members are compared with a hub, those linked are done and
leave, except members that the triangle inequality lets reach one that is not done;
while hubs link much of what is open, they go on. The members of other groups go on after
``HUB_ROUNDS`` hubs by prefix lists, once however many groups they are in. Two sets of
similarity t share one of the first n - ceil(t n) + 1 elements of each in any order
that is the same for all; elements are ordered rarest first by a bounded table of
counts, so what a template's pages have in common makes no list. Lists are
compared like clusters. Lists that are large even so go by hubs in the same way, and what
is left of them is cut into blocks, each two of which are compared like a cluster: the number of
rounds does not grow with a list. Where full sets are compared, parity bits that tell a least difference
leave out most pairs that cannot link.

Defined results
* null or empty text, or no words: empty set, linked with nothing
* null ``doc_id``: never linked; null component, kept
* rows that share a ``doc_id`` are one document and share its links
* an empty table gives no rows; more columns in the input are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .components import connected_components
from .store import Scratch
from .textblock import U64, Words, arrow_bytes, mix, shingle_sets, slices, trimmed

TREES = 12
AXES = 2 * TREES
SKETCH = 64
BRANCHES = 2
NODE_CAP = 4000
MAX_DEPTH = 3
CLUSTER_CAP = 4000
HUB_ROUNDS = 2
DENSE = 0.2  # share of the open members that a hub must link for hubs to go on: rounds stay logarithmic
COUNTERS = 1 << 18  # of elements, for the order of prefix lists
CLUSTER_SHINGLES = 8_000_000
SURE_IDS = 1_000_000  # ids that may be broadcast: 16 MB
ALIKE = SKETCH // 2

_MULTIPLIERS = mix(np.arange(1, SKETCH + 1, dtype=U64)) | U64(1)
SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, mins array<long>, sketch binary"


def _signatures(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                flat, at = shingle_sets(Words(data[base : offsets[b]], offsets[a : b + 1] - base), k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                low = np.zeros((b - a, SKETCH), U64)
                if len(full):
                    for j in range(SKETCH):
                        low[full, j] = np.minimum.reduceat(flat * _MULTIPLIERS[j], at[full])
                keys = np.zeros((b - a, 2), np.int64)
                for i in full:
                    keys[i] = np.frombuffer(hashlib.md5(flat[at[i] : at[i + 1]]).digest(), np.int64)
                trees = pa.ListArray.from_arrays(
                    np.arange(0, (b - a + 1) * AXES, AXES, dtype=np.int32), pa.array(np.ascontiguousarray(low[:, :AXES]).view(np.int64).ravel())
                )
                short = mix(low).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(size), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        trees, pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "mins", "sketch"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
    """Runs of equal first column over sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None

    def joined() -> list[pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks()
        return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and k[a] != key:
                yield key, joined()
                held = []
            key = k[a]
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield key, joined()


def reach(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component number of each of n members; ``near(i, rest)`` tells which of ``rest`` link with i."""
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        label[seed] = seed
        queue = [seed]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found = rest[hit]
            label[found] = seed
            rest = rest[~hit]
            queue += found.tolist()
    return label


def _stars(reps: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each member to the smallest member of its component."""
    order = np.lexsort((reps, label))
    lab, rep = label[order], reps[order]
    head = np.concatenate([[True], lab[1:] != lab[:-1]])
    least = rep[np.flatnonzero(head)][np.cumsum(head) - 1]
    far = rep != least
    return rep[far], least[far]


def _edge_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _agree(s: np.ndarray, rest: np.ndarray, i: int) -> np.ndarray:
    """In how many tokens each sketch of ``rest`` agrees with sketch i."""
    eight = (s[rest] == s[i]).view(U64)  # eight comparisons a number; their sums stay below 256
    return eight.sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between members of a node whose sketches agree often enough."""
    found = []
    for _, (_, rep, sketch) in groups(batches):
        reps = rep.to_numpy(zero_copy_only=False)
        s = np.frombuffer(b"".join(sketch.to_pylist()), np.uint16).reshape(len(reps), SKETCH)
        found.append(_stars(reps, reach(len(reps), lambda i, rest, s=s: _agree(s, rest, i) >= ALIKE)))
        if len(found) >= 2000:
            yield _edge_batch(found)
            found = []
    yield _edge_batch(found)


def linked(inter: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * union


def _parities(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of bits a set: whether an even or odd number of its elements fall on each. Two rows differ in no more bits than their sets in elements."""
    n = len(at) - 1
    bits = 64 << int(np.ceil(np.log2(max(1.0, 2.5 * np.median(np.diff(at)) / 64))))
    out = np.zeros((n, bits // 64), U64)
    slot = mix(codes.astype(U64)) & U64(bits - 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    np.bitwise_xor.at(out, (owner, (slot >> U64(6)).astype(np.int64)), U64(1) << (slot & U64(63)))
    return out


def _exact(percent: int) -> Callable:
    """Edges between members of a group whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, (_, rep, sets) in groups(batches):
            reps = rep.to_numpy(zero_copy_only=False)
            data = [np.frombuffer(x, U64) for x in sets.to_pylist()]
            sizes = np.array([len(x) for x in data])
            _, codes = np.unique(np.concatenate(data), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
            parity = _parities(codes, at) if len(reps) > 2 else None

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                mine = codes[at[i] : at[i + 1]]
                mark[mine] = True
                inter = np.zeros(len(rest), np.int64)
                fits = np.flatnonzero((100 * sizes[rest] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[rest]))
                if parity is not None and len(fits):
                    r = rest[fits]
                    apart = np.bitwise_count(parity[r] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    fits = fits[(100 + percent) * apart <= (100 - percent) * (sizes[r] + sizes[i])]
                if len(fits):
                    r = rest[fits]
                    n = sizes[r]
                    start = np.concatenate([[0], np.cumsum(n)[:-1]])
                    where = np.repeat(at[r] - start, n) + np.arange(int(n.sum()))
                    inter[fits] = np.add.reduceat(mark[codes[where]].astype(np.int64), start)
                mark[mine] = False
                return linked(inter, sizes[rest] + sizes[i] - inter, percent) & (inter > 0)

            found.append(_stars(reps, reach(len(reps), near)))
            if len(found) >= 500:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                flat, at = shingle_sets(Words(data[base : offsets[b]], offsets[a : b + 1] - base), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    ["rep", "shingles"],
                )

    return run


def _by_group(df: DataFrame, run: Callable) -> DataFrame:
    """``run`` over runs of equal ``grp``; rows of a group are together and sorted."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, "grp").sortWithinPartitions("grp", "rep").mapInArrow(trimmed(run), "a long, b long")


def _nodes(reps: DataFrame, scratch: Scratch, cap: int) -> tuple[DataFrame, DataFrame]:
    """(grp, rep) of the nodes to compare exhaustively, and of those left large at the end of branching."""
    h = F.xxhash64
    pairs = F.array(*[h(F.lit(t), F.col("mins")[2 * t], F.col("mins")[2 * t + 1]) for t in range(TREES)])
    rows = reps.select("rep", F.explode(pairs).alias("grp"))
    small, left = [], []
    for depth in range(MAX_DEPTH):
        count = rows.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(h("rep")).alias("x"), F.bit_xor(h("rep", F.lit(1))).alias("y"))
        count = scratch.keep(count.filter("n > 1"), f"nodes{depth}")
        # trees often hold the same members in a node: one of them is enough
        once = count.filter(F.col("n") <= cap).groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp")
        small.append(rows.select("grp", "rep").join(once, "grp"))
        large = count.filter(F.col("n") > cap).select("grp")
        if large.isEmpty():
            break
        held = scratch.keep(rows.join(large, "grp"), f"large{depth}")
        if depth == MAX_DEPTH - 1:
            left.append(held.select("grp", "rep"))
            break
        axis = F.pmod(h("grp", "branch"), F.lit(AXES)).cast("int")
        rows = (
            held.join(reps.select("rep", "mins"), "rep")
            .withColumn("branch", F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)])))
            .withColumn("axis", axis)
            .select("rep", h("grp", "axis", F.element_at("mins", F.col("axis") + 1)).alias("grp"))
        )
    both = [reduce(DataFrame.unionByName, x) if x else scratch.spark.createDataFrame([], "grp long, rep long") for x in (small, left)]
    return both[0], both[1]


def _by_hubs(rows: DataFrame, percent: int, scratch: Scratch, cap: int, rounds: int = HUB_ROUNDS) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """From groups (grp, rep, shingles) of any size: edges, smaller groups, and large groups of which hubs link too little.

    Each round compares a group's members with one that no hub has linked. What
    it links is done: it stays only while it may reach a member that is not. Where a
    hub links less than ``DENSE`` of the open members, the group is given back after
    ``rounds`` rounds.
    """
    edges, columns = [], ["grp", "rep", "shingles"]
    rest = sparse = scratch.spark.createDataFrame([], rows.schema)
    rows = rows.select(*columns, F.lit(False).alias("done"), F.lit(True).alias("dense"))
    turn = 0
    far = (100 - percent) / 100
    while True:
        size = scratch.keep(rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("open")).filter("open > 0"), "sizes")
        rest = rest.unionByName(rows.join(size.filter(F.col("n") <= cap), "grp", "left_semi").select(*columns))
        rows = rows.join(size.filter(F.col("n") > cap), "grp", "left_semi")
        if turn == rounds:
            sparse = rows.filter("not dense").select(*columns)
            rows = rows.filter("dense")
        elif turn > rounds:
            sparse = sparse.unionByName(rows.filter("not dense").select(*columns))
            rows = rows.filter("dense")
        rows = scratch.keep(rows, "rows")
        if rows.isEmpty():
            return edges, rest, sparse
        hub = rows.filter("not done").groupBy("grp").agg(F.min_by(F.struct("rep", "shingles"), F.xxhash64("rep", F.lit(turn))).alias("hub"))
        hub = scratch.keep(hub.select("grp", F.col("hub.rep").alias("hub"), F.col("hub.shingles").alias("hub_shingles")), "hubs")
        near = rows.join(hub, "grp").select("grp", "rep", "shingles", "hub", "hub_shingles", "done")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                inter, union = [], []
                for x, y in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    i = len(np.intersect1d(p, q, assume_unique=True))
                    inter.append(i)
                    union.append(len(p) + len(q) - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), b.column(3), b.column(5), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                    ["grp", "rep", "shingles", "hub", "done", "inter", "total"],
                )

        near = near.mapInArrow(trimmed(measure), "grp long, rep long, shingles binary, hub long, done boolean, inter long, total long")
        near = scratch.keep(near.withColumn("ok", F.expr(f"100 * inter >= {percent} * total")).withColumn("d", F.expr("1 - inter / total")), "hub")
        edges.append(near.filter("ok and rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
        left = ~F.col("done") & ~F.col("ok")
        gap = near.groupBy("grp").agg(
            F.min(F.when(left, F.col("d"))).alias("least"), F.max(F.when(left, F.col("d"))).alias("most"),
            (F.count_if(~F.col("done") & F.col("ok") & (F.col("rep") != F.col("hub"))) >= DENSE * F.count_if(~F.col("done"))).alias("dense"),
        )
        gap = scratch.keep(gap.filter("least is not null"), "gap")
        reaches = F.col("d").between(F.col("least") - F.lit(far) - 1e-9, F.col("most") + F.lit(far) + 1e-9)
        rows = near.join(gap, "grp").filter(left | reaches).select(*columns, (F.col("done") | F.col("ok")).alias("done"), "dense")
        turn += 1


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) & U64(COUNTERS - 1)).astype(np.int64)


def _element_counts(rows: DataFrame) -> np.ndarray:
    """How often elements occur in the sets, by their hash's slot: a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, _slots(np.frombuffer(x.as_buffer(), U64)), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    found = rows.select("shingles").mapInArrow(trimmed(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefix_lists(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(grp, rep): the lists of rare elements that hold every linked pair of the rows (rep, shingles) together."""
    shared = scratch.spark.sparkContext.broadcast(_element_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps = [], []
            for rep, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(x.as_buffer(), U64)
                n = len(tokens)
                first = np.lexsort((tokens, shared.value[_slots(tokens)]))[: n - -(-percent * n // 100) + 1]
                keys.append(tokens[first].view(np.int64))
                reps.append(np.full(len(first), rep, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, reps)], ["grp", "rep"])

    lists = scratch.keep(rows.select("rep", "shingles").mapInArrow(trimmed(run), "grp long, rep long"), "lists")
    h = F.xxhash64
    count = lists.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(h("rep")).alias("x"), F.bit_xor(h("rep", F.lit(1))).alias("y")).filter("n > 1")
    once = count.groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp")  # of lists with the same members one is enough
    return scratch.keep(lists.join(once, "grp"), "lists")


def _blocks(rows: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """Groups (grp, rep, shingles) of any size as groups of about ``cap`` members that hold each pair together: one for every two blocks of half as many."""
    size = scratch.keep(rows.groupBy("grp").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * 2 / cap)).alias("blocks")), "blocks")
    spread = rows.join(size, "grp").withColumn("one", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = spread.withColumn("two", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("one <> two")
    return spread.select(F.xxhash64("grp", F.least("one", "two"), F.greatest("one", "two")).alias("grp"), "rep", "shingles")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, node_cap: int = NODE_CAP, cluster_cap: int = CLUSTER_CAP) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    signed = scratch.keep(docs.mapInArrow(trimmed(_signatures(k)), SIGNED), "signed")
    same = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"))
    )
    same = scratch.keep(same, "same")
    small, left = _nodes(same.select("rep", "mins"), scratch, node_cap)
    small, left = scratch.keep(small, "small"), scratch.keep(left, "left")
    alike = _by_group(small.join(same.select("rep", "sketch"), "rep").select("grp", "rep", "sketch"), _alike)
    hubs = left.join(left.groupBy("grp").agg(F.min("rep").alias("b")), "grp").select(F.col("rep").alias("a"), "b")
    clusters = connected_components(alike.unionByName(hubs), scratch).select(F.col("v").alias("rep"), F.col("component").alias("cluster"))
    clusters = scratch.keep(clusters, "clusters")
    shingles = same.select("rep", "n").groupBy("rep").agg(F.sum("n").alias("n"))
    size = clusters.join(shingles, "rep").groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    over = (F.col("members") > cluster_cap) | (F.col("n") > CLUSTER_SHINGLES)
    large = scratch.keep(size.filter(over).select("cluster"), "large")
    any_large = not large.isEmpty()

    involved = clusters.select("rep")
    if involved.count() <= SURE_IDS:
        involved = F.broadcast(involved)  # at most SURE_IDS ids; beyond that a shuffle join
    sets = docs.join(involved, docs.doc_id == involved.rep, "left_semi").mapInArrow(trimmed(_sets(k)), "rep long, shingles binary")
    sets = sets.filter(F.length("shingles") > 0)
    if not any_large:
        grouped = sets.join(clusters, "rep").select(F.col("cluster").alias("grp"), "rep", "shingles")
        links = scratch.keep(_by_group(grouped, _exact(percent)), "links")
        # a cluster's links are stars around smallest members, so they are the components
        found = links.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("component"))
    else:
        sets = scratch.keep(sets, "sets")
        out = clusters.join(large, "cluster", "left_semi").select("rep")
        members = clusters.join(large, "cluster", "left_anti").select(F.col("cluster").alias("grp"), "rep").unionByName(small.join(out, "rep", "left_semi").select("grp", "rep"))
        wide = scratch.keep(left.join(sets, "rep").select("grp", "rep", "shingles"), "wide")
        more, rest, wide = _by_hubs(wide, percent, scratch, node_cap, HUB_ROUNDS)
        rest = [rest]
        if not wide.isEmpty():
            # a member is in many groups of like members: one row of it is enough, for its lists hold all it can link with
            wide = scratch.keep(wide.select("rep").distinct().join(sets, "rep"), "open")
            lists = _prefix_lists(wide, percent, scratch)
            lists = scratch.keep(lists.join(sets, "rep").select("grp", "rep", "shingles"), "listed")
            edges, small_lists, large_lists = _by_hubs(lists, percent, scratch, node_cap, HUB_ROUNDS)
            more, rest = [*more, *edges], [*rest, small_lists]
            if not large_lists.isEmpty():
                rest.append(_blocks(large_lists, node_cap, scratch))
        grouped = reduce(DataFrame.unionByName, [members.join(sets, "rep").select("grp", "rep", "shingles"), *rest])
        edges = reduce(DataFrame.unionByName, [_by_group(grouped, _exact(percent)), *more])
        found = connected_components(edges, scratch).select(F.col("v").alias("rep"), "component")
    found = scratch.keep(found, "found")
    copies = same.filter("copies > 1").select("k1", "k2", "rep")
    rows = signed.select("doc_id", "n_shingles", "k1", "k2").join(copies, ["k1", "k2"], "left")
    rows = rows.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).join(found, "rep", "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, unchanged, without all but the first of each group of near-duplicates.

    Rows without ``doc_id`` stay; of rows that share a ``doc_id`` one stays.
    """
    scratch = Scratch(docs.sparkSession, "first")
    ids = near_duplicates(docs, k, percent).select("doc_id", "kept").filter("doc_id is not null")
    count = ids.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
    count = scratch.keep(count, "out")
    gone, repeated = count.filter("not kept").select("doc_id"), count.filter("kept").select("doc_id")
    small = count.count() <= SURE_IDS
    out = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")  # at most SURE_IDS ids are broadcast
    if not repeated.isEmpty():
        ids = F.broadcast(repeated) if small else repeated
        out = out.join(ids, "doc_id", "left_anti").unionByName(out.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(docs.columns)


#: Four-word near-duplicates as SQL over ``documents``, by all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(l.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least_id l ON w.doc_id = l.a
"""
