"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed into one of a fixed number of slots; bytes and rows are
summed per slot, and a small map says which shard holds each slot. Rebalancing
edits that map only: records never change slot, so moving a slot moves its rows
as one unit. The map has one row a slot, so it is bounded by ``n_slots``
whatever the data and may be built on the driver and broadcast. ``shard_documents``
deals the slots out in turn as version 1 and rebalances by the bytes found in
them as version 2.

Rows repeated in full have one hash. Where such rows outweigh a slot's share they
are dealt over all slots in turn; there are fewer such records than slots.

Defined results
* null text counts as an empty text: 16 bytes, CRC 0
* null ``doc_id`` is hashed like any other value, together with the text's CRC
* rows repeated in full share a slot, unless together they are heavier than a slot's share
* an empty table gives no rows; more columns in the input are ignored
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch

N_SLOTS = 8192
ROW_OVERHEAD = 16
MAP_SCHEMA = "version int, vslot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """``shards[i]`` is the shard of slot i."""

    version: int
    shards: tuple[int, ...]


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each record: one scan, no text kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def spread_repeats(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Records of which equal ones that together are heavier than a slot's share lie in many slots."""
    key = ["doc_id", "text_crc32", "size"]
    stats = slot_stats(records).collect()  # at most n_slots rows
    share = sum(r["bytes"] for r in stats) / n_slots
    full = [r.vslot for r in stats if r["bytes"] > share and r["rows"] > 1]
    # a record heavier than a share lies in a slot heavier than one
    inside = records.join(F.broadcast(records.sparkSession.createDataFrame([(v,) for v in full], "vslot int")), "vslot")
    heavy = inside.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") * F.col("size") > share))
    rows = heavy.select(*key).collect()  # fewer than n_slots rows
    if not rows:
        return records
    table = records.sparkSession.createDataFrame([(r.doc_id, r.text_crc32, r["size"], True) for r in rows], "h_id long, h_crc long, h_size long, heavy boolean")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("h_id")) & (F.col("text_crc32") == F.col("h_crc")) & (F.col("size") == F.col("h_size"))
    turn = F.pmod(F.col("vslot") + F.monotonically_increasing_id(), F.lit(n_slots)).cast("int")
    return records.join(F.broadcast(table), same, "left").withColumn("vslot", F.when(F.col("heavy"), turn).otherwise(F.col("vslot"))).select(*records.columns)


def dealt_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """First version without knowledge of sizes: slots in turn."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    return SlotMap(1, tuple(slot % n_shards for slot in range(n_slots)))


def build_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """First version: heaviest slot first, always to the lightest shard."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + slot_bytes.get(slot, 0), shard))
    return SlotMap(1, tuple(shards))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], n_shards: int, tolerance: float = 0.02) -> SlotMap:
    """The next version of a map, for new sizes or another number of shards.

    Slots of shards that no longer exist move first; then slots leave the
    heaviest shard for the lightest one while that one is more than
    ``tolerance`` under the mean and the move lowers the larger of the two.
    All other slots stay where they are.
    """
    shards = list(old.shards)
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(shards):
        if shard < n_shards:
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)

    def put(slot: int, shard: int) -> None:
        shards[slot] = shard
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].append(slot)

    for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
        put(slot, min(range(n_shards), key=lambda s: (load[s], s)))
    mean = sum(load) / n_shards
    for _ in range(len(shards)):
        low = min(range(n_shards), key=lambda s: (load[s], s))
        high = max(range(n_shards), key=lambda s: (load[s], -s))
        if load[low] >= mean * (1 - tolerance) and load[high] <= mean * (1 + tolerance):
            break
        gap = load[high] - load[low]
        movable = [s for s in held[high] if 0 < slot_bytes.get(s, 0) < gap]
        if not movable:
            break
        slot = min(movable, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        held[high].remove(slot)
        load[high] -= slot_bytes[slot]
        put(slot, low)
    return SlotMap(old.version + 1, tuple(shards))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append one version to the stored map; earlier versions stay readable."""
    rows = [(slot_map.version, i, s) for i, s in enumerate(slot_map.shards)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """One stored version, the latest by default. Bounded: one row a slot."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, tuple(r.shard for r in rows))


def place(records: DataFrame, slot_map: SlotMap, slot_rows: dict[int, int]) -> DataFrame:
    """Shard and gapless position within the shard for every record.

    A record's position is the number of rows in the shard's earlier slots plus
    its rank inside its own slot, so no window is larger than one slot.
    """
    spark = records.sparkSession
    first = [0] * (max(slot_map.shards, default=0) + 1)
    rows = []
    for slot, shard in enumerate(slot_map.shards):
        rows.append((slot, shard, first[shard], slot_map.version))
        first[shard] += slot_rows.get(slot, 0)
    table = spark.createDataFrame(rows, "vslot int, shard int, base long, map_version int")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.withColumn("rank", rank)
        .join(F.broadcast(table), "vslot")  # one row a slot: at most n_slots rows
        .withColumn("slot", F.col("base") + F.col("rank") - 1)
        .drop("base", "rank")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """All records placed into shards of near equal bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    records = scratch.keep(sized(docs, n_slots), "sized")
    spread = spread_repeats(records, n_slots)
    if spread is not records:
        records = scratch.keep(spread, "spread")
    stats = slot_stats(records).collect()  # at most n_slots rows
    slot_bytes = {r.vslot: r["bytes"] for r in stats}
    path = map_path or f"{scratch.path}/slot-map"
    first = dealt_map(n_shards, n_slots)
    write_map(spark, first, path)
    write_map(spark, rebalance(first, slot_bytes, n_shards, tolerance=0), path)
    return place(records, read_map(spark, path), {r.vslot: r["rows"] for r in stats})
