"""Running streams over files to their end, with durable progress."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cdc import split_by_rules, with_rules
from ..operators.changelog import latest, retract_pairs
from ..sources.sinks import upserts
from ..sources.tables import BucketTable, Files, commit_batch, committed


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the cluster's shared folder; a temporary one only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideline-stream-")
    _made.append(f"{base}/tideline-{what}-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


def clear_work(spark: SparkSession) -> None:
    """Remove the folders that ``work_dir`` has named so far; what is read from them must have been used."""
    while _made:
        path = _made.pop()
        Files(spark, path).delete(path)


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Partitions of new streams: ``n``, or one a core of the cluster.

    Adaptive execution does not merge those of a stream, and each one of each
    stateful operator is a store of its own; a resumed stream keeps its number.
    """
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def many(spark: SparkSession) -> int:
    """As many partitions as keep a task's sort in memory: adaptive execution merges small ones, but cuts no large ones."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """Joins by several columns leave rows where they are that are dealt out by one of them; Spark asks for all of them unless told.

    Narrow rows become wide after they are dealt out and before they are sorted, so a task gets fewer bytes of them than Spark's 64 MB.
    """
    new = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    old = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


@contextmanager
def _empty_batches(spark: SparkSession, on: bool) -> Iterator[None]:
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, str(on).lower())
    try:
        yield
    finally:
        spark.conf.set(name, old)


def drain(stream: DataFrame, path: str, mode: str = "append", partitions: int | None = None, empty_batches: bool = True) -> DataFrame:
    """Run a stream until its input is used up and read what it wrote.

    ``append`` writes files; ``complete`` replaces the table in every batch.
    Started again on the same path it goes on where it stopped. A stream whose state
    has a lifetime asks for one more empty batch for ever: run it without them.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True)
    with shuffle_partitions(spark, partitions), _empty_batches(spark, empty_batches):
        if mode == "append":
            query = writer.format("parquet").start(f"{path}/rows")
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def each_batch(stream: DataFrame, path: str, work: Callable[[DataFrame, int], None], hold: bool = True, partitions: int | None = None) -> None:
    """Run ``work`` on every micro-batch, held in memory while it writes to several sinks unless ``hold`` is false.

    Joins and sums within ``work`` go over ``partitions``, one a core unless told otherwise.
    """

    def run(df: DataFrame, batch_id: int) -> None:
        if not hold:
            return work(df, batch_id)
        df.persist()
        try:
            work(df, batch_id)
        finally:
            df.unpersist()

    with shuffle_partitions(stream.sparkSession, partitions):
        query = stream.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(run).start()
        query.awaitTermination()


def route_stream(cdc: DataFrame, rules_now: Callable[[int], DataFrame], path: str) -> tuple[str, str]:
    """Route a change stream by rules that may change while it runs.

    Every batch reads the rules in force (``kept_rules`` has those of a rule stream). While
    there are none, batches wait, each in a folder of its own, and are routed with the first
    batch that sees rules. A replay routes what it routed before and writes nothing twice.
    """
    spark = cdc.sparkSession
    dims, facts, waits, let_go = (f"{path}/{x}" for x in ("dims", "facts", "pending", "released"))
    files = Files(spark, path)

    def work(df: DataFrame, batch_id: int) -> None:
        rules = rules_now(batch_id)
        rows = df.limit(0)
        if rules.isEmpty():
            commit_batch(df, waits, batch_id)
        else:
            released = {int(n.split("-")[0]): int(n.split("-")[1]) for n in files.names(let_go)}
            mine = [b for b in sorted(committed(spark, waits)) if b < batch_id and released.get(b, batch_id) == batch_id]
            for b in mine:
                if b not in released:
                    files.write_once(f"{let_go}/{b}-{batch_id}", "")
            rows = df
            if mine:
                rows = spark.read.schema(df.schema).parquet(*[f"{waits}/batch={b}" for b in mine]).unionByName(df)
        routed = with_rules(rows, rules).persist()  # joined once for both sides
        dim, fact = split_by_rules(routed, rules)
        commit_batch(dim, dims, batch_id)
        commit_batch(fact, facts, batch_id)
        routed.unpersist()

    each_batch(cdc, path, work)
    return dims, facts


def late_rows_aside(stream: DataFrame, path: str, size_s: int, delay_s: int, time: str = "et") -> tuple[str, str]:
    """Rows in time and, aside, rows that come after their window has closed; Spark's own windows drop these unseen.

    A row is late if its window of ``size_s`` seconds ends at or before the watermark, which is the
    greatest event time of all earlier batches less the delay. The greatest time up to a batch is noted before
    the batch is written, so a replay splits it as before.
    """
    spark, files = stream.sparkSession, Files(stream.sparkSession, path)
    in_time, late = f"{path}/in_time", f"{path}/late"

    def top(batch_id: int) -> int | None:
        pin = f"{path}/tops/{batch_id}"
        return int(files.read(pin)) if batch_id >= 0 and files.exists(pin) else None

    def work(df: DataFrame, batch_id: int) -> None:
        before = top(batch_id - 1)
        if top(batch_id) is None:
            own = df.agg(F.max(F.unix_micros(time))).first()[0]
            known = [t for t in (before, own) if t is not None]
            if known:
                files.write_once(f"{path}/tops/{batch_id}", str(max(known)))
        closed = F.lit(False)
        if before is not None:
            end = (F.floor(F.unix_micros(time) / (size_s * 1_000_000)) + 1) * (size_s * 1_000_000)
            closed = F.coalesce(end <= before - delay_s * 1_000_000, F.lit(False))
        commit_batch(df.filter(~closed), in_time, batch_id)
        commit_batch(df.filter(closed), late, batch_id)

    each_batch(stream, path, work)
    return in_time, late


RULE_COLUMNS = ("source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key")


def keep_rules(changes: DataFrame, table: BucketTable, path: str) -> None:
    """Run a stream of rule changes (op, ts_ms, seq, after, before) into a rule table keyed by ``rule_key``.

    Deletes stay as rows, so that a late change cannot bring a deleted rule back.
    """
    rule = F.coalesce("after", "before")
    rows = changes.select(F.try_element_at(rule, F.lit("source_table")).alias("rule_key"), "op", "ts_ms", "seq", rule.alias("rule"))
    each_batch(rows.filter("rule_key is not null"), path, upserts(table, ["ts_ms", "seq"]))


def kept_rules(table: BucketTable) -> DataFrame:
    """The rules in force in the table's latest version."""
    held = table.read()
    if held is None:
        return table.spark.createDataFrame([], ", ".join(f"{c} string" for c in RULE_COLUMNS))
    return held.filter("op <> 'd'").select(*[F.try_element_at("rule", F.lit(c)).alias(c) for c in RULE_COLUMNS])


def lookup_stream(stream: DataFrame, table: BucketTable, path: str, join: Callable[[DataFrame, DataFrame], DataFrame], on: list[str] | None = None) -> str:
    """Join each micro-batch with the version of a dimension that is the latest when the batch first runs.

    So a row gets the names of its time. The version is noted before the batch is
    written, and a replay reads the same one; ``vacuum`` has to leave it that long.
    ``on`` names the stream's columns that meet the dimension's keys: then only the buckets of
    the batch's keys are read, so a small batch costs little beside a large dimension.
    """
    spark, files = stream.sparkSession, Files(stream.sparkSession, path)

    def work(df: DataFrame, batch_id: int) -> None:
        pin = f"{path}/pins/{batch_id}"
        if not files.exists(pin):
            files.write_once(pin, str(table.version().number))
        number = int(files.read(pin))
        snapshot = table.read_near(df, on, number) if on else table.read(number)
        if snapshot is None:
            raise ValueError(f"{table.path} has no rows yet")
        commit_batch(join(df, snapshot), f"{path}/rows", batch_id)

    each_batch(stream, path, work)
    return f"{path}/rows"


def retract_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], measures: list[str], n_buckets: int = 64, between: Callable[[int], None] | None = None) -> DataFrame:
    """Retractions without a process per key: the last rows are a table by bucket.

    Each batch follows the stored rows of its keys' buckets by window functions, so millions
    of keys cost one shuffle a batch and other buckets are not touched. Rows are committed
    before the table, and ``between`` the two a batch may fail: the table is still the
    old one then, the rows stay the files they are, and only the table is made up for.
    """
    spark = stream.sparkSession
    table = BucketTable(spark, f"{path}/last", keys, n_buckets, keep=2)

    def work(df: DataFrame, batch_id: int) -> None:
        def merged(held: DataFrame | None, new: DataFrame) -> DataFrame:
            rows = new.withColumn("_seen", F.lit(1))
            if held:
                rows = held.withColumn("_seen", F.lit(0)).unionByName(rows)
            out = retract_pairs(rows, keys, ["_seen", *order], measures)
            commit_batch(out.filter("_seen = 1 or sign = -1").drop("_seen"), f"{path}/rows", batch_id)
            if between:
                between(batch_id)
            return latest(rows, keys, ["_seen", *order]).drop("_seen")

        table.merge(df, batch_id, merged)

    each_batch(stream, path, work)
    return spark.read.parquet(f"{path}/rows").drop("batch")
