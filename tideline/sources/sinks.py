"""Sinks, as batch writes and as streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.scalars import normalise_epoch, ts_to_partition
from ..operators.cdc import rows_to_json
from ..operators.changelog import apply_dim_changes, latest
from .tables import BucketTable, Files, commit_batch, committed


def write_lines(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Rows as JSON lines, appended; a stream runs until its input is used up."""
    lines = rows_to_json(df)
    if df.isStreaming:
        return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    lines.write.mode("append").text(path)
    return None


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Rows as JSON to a Kafka topic, acknowledged by all replicas; needs Spark's Kafka package."""
    out = rows_to_json(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).start()


def day_bucket(value: Column | str) -> Column:
    """yyyyMMdd of an epoch in seconds or milliseconds; missing counts as 0, unreadable is ``error_bucket``."""
    c = F.col(value) if isinstance(value, str) else value
    number = F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(c.cast("string").try_cast("bigint"))
    return F.coalesce(ts_to_partition(normalise_epoch(number)), F.lit("error_bucket"))


def write_day_buckets(df: DataFrame, path: str, ts_field: str | None, rows_a_file: int = 1_000_000) -> None:
    """JSON lines in ``day=`` directories, or in one directory without a field."""
    lines = df.select(F.to_json(F.struct("*")).alias("value"), *([day_bucket(ts_field).alias("day")] if ts_field else []))
    out = lines.write.mode("append").option("maxRecordsPerFile", rows_a_file)
    (out.partitionBy("day") if ts_field else out).text(path)


class RollingFiles:
    """A batch writer of JSON lines in ``day=`` directories, in files of a size whatever the batches' sizes.

    Lines that do not fill a file stay open, in a folder of their own, and go on with the next
    batch; so small batches make no small files. A day's open lines are closed as they are once they
    are ``age_s`` old or nothing came for ``idle_s`` seconds. No file is larger than ``most_bytes``
    unless one line is, and none but those is smaller by more than twice the largest line of its batch.

    A day's lines are dealt over ``chunks`` by their hash, and the bytes before a chunk are summed up from
    one row a chunk, so no task holds a day. ``now`` is noted for each batch before it is written: a replay
    does what was done before.
    """

    def __init__(self, path: str, ts_field: str, most_bytes: int = 128 << 20, age_s: float = 600, idle_s: float = 300, chunks: int = 64, now: Callable[[], float] = time.time):
        self.path, self.ts_field, self.most_bytes, self.age_s, self.idle_s, self.chunks, self.now = path, ts_field, most_bytes, age_s, idle_s, chunks, now

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, files = batch.sparkSession, Files(batch.sparkSession, self.path)
        pin, held = f"{self.path}/_now/{batch_id}", f"{self.path}/_open"
        if not files.exists(pin):
            files.write_once(pin, str(self.now()))
        now = F.lit(float(files.read(pin)))
        rows = batch.select(F.to_json(F.struct("*")).alias("value"), day_bucket(self.ts_field).alias("day"), now.alias("since"), now.alias("seen"))
        before = [b for b in committed(spark, held) if b < batch_id]
        if before:
            rows = spark.read.schema(rows.schema).parquet(f"{held}/batch={max(before)}").unionByName(rows)
        numbered = self._numbered(rows).persist()
        due = (now - F.col("since") >= self.age_s) | (now - F.col("seen") >= self.idle_s)
        closed = (F.col("file") < F.col("last")) | due
        lines = numbered.filter(closed).select("value", "day", "file").repartition("day", "file")
        commit_batch(lines, f"{self.path}/lines", batch_id, "day", "file", form="text")
        # an open file began with its day's oldest open line, or now if the lines before it filled another
        since = F.when(F.col("last") > 0, now).otherwise(F.col("since")).alias("since")
        commit_batch(numbered.filter(~closed).select("value", "day", since, "seen"), held, batch_id)
        numbered.unpersist()
        for b in before[:-1]:
            files.delete(f"{held}/batch={b}")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Lines with the number of their file in their day, and that of the day's last one."""
        size = F.octet_length("value") + 1
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("value"), F.lit(self.chunks)))
        sums = rows.groupBy("day", "chunk").agg(F.sum(size).alias("bytes"), F.max(size).alias("line"), F.min("since").alias("since"), F.max("seen").alias("seen"))
        day = Window.partitionBy("day")
        sums = sums.select(
            "day", "chunk", (F.sum("bytes").over(day.orderBy("chunk")) - F.col("bytes")).alias("start"), F.sum("bytes").over(day).alias("total"),
            F.max("line").over(day).alias("line"), F.min("since").over(day).alias("since"), F.max("seen").over(day).alias("seen"),
        )
        room = F.greatest(F.lit(self.most_bytes) - F.col("line") + 1, F.lit(1))  # a file's first line may begin in the one before
        end = F.col("start") + F.sum(size).over(Window.partitionBy("day", "chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        full = F.floor(F.col("total") / room) * room  # a last file that is just full is closed like the others
        out = rows.drop("since", "seen").join(sums, ["day", "chunk"]).withColumn("end", end)
        return out.withColumn("file", F.floor((F.col("end") - 1) / room)).withColumn("last", F.floor(full / room))


def write_window_result(df: DataFrame, path: str, by: str = "cur_date") -> None:
    """Replace the partitions that the result holds: writing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def window_results(path: str, by: str = "cur_date") -> Callable[[DataFrame, int], None]:
    """A batch writer for closed windows: each batch is added once, however often it is tried."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not commit_batch(batch, path, batch_id, by):
            batch.write.format("noop").mode("overwrite").save()  # the windows' state has to go on with the batch

    return run


def upserts(table: BucketTable, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the last row of each key; rewrites the buckets of the batch's keys."""

    def run(batch: DataFrame, batch_id: int) -> None:
        new = latest(batch, table.keys, order).persist()
        table.merge(new, batch_id, lambda held, rows: latest(held.unionByName(rows), table.keys, order) if held else rows)
        new.unpersist()

    return run


def dim_changes(table: BucketTable, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that applies puts and deletes (row_key, op, seq, cells map) to a dimension, keyed by row_key.

    What the dimension holds counts as puts before the batch. Batches come in order of ``seq``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        def merged(held: DataFrame | None, rows: DataFrame) -> DataFrame:
            if held:
                rows = _as_puts(held, columns, rows).unionByName(rows)
            return apply_dim_changes(rows, columns)

        table.merge(batch.select("row_key", "op", "seq", "cells"), batch_id, merged)

    return run


def _as_puts(held: DataFrame, columns: list[str], changes: DataFrame) -> DataFrame:
    cells = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])
    seq = F.lit(-(2**63)).cast(changes.schema["seq"].dataType)
    return held.select("row_key", F.lit("u").alias("op"), seq.alias("seq"), cells.alias("cells"))


def dim_batches(path: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that applies puts and deletes (row_key, op, seq, cells map) to a dimension, a version a batch.

    For dimensions small enough to be written whole each batch; ``dim_changes`` is for larger ones.
    What the dimension holds counts as puts before the batch. Batches come in
    order of ``seq``; a replayed one writes the same version again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("row_key", "op", "seq", "cells")
        if batch_id:
            rows = _as_puts(batch.sparkSession.read.parquet(f"{path}/version={batch_id - 1}"), columns, batch).unionByName(rows)
        apply_dim_changes(rows, columns).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return run
