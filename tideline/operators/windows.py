"""Event time, tumbling windows and the aggregates over them.

Every function takes batch and streaming frames alike, unless it says otherwise;
event time is a column ``et``. Aggregation is partial before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_time
from .joins import enrich

MONEY = "decimal(16,2)"


def with_event_time(df: DataFrame, ms: str, delay: str | None = None) -> DataFrame:
    """Event time from milliseconds, with a watermark where the frame is a stream."""
    out = df.withColumn("et", event_time(ms))
    return out.withWatermark("et", delay) if df.isStreaming and delay is not None else out


def with_event_time_fallback(df: DataFrame, columns: Sequence[str], delay: str | None = None, unit: str = "s") -> DataFrame:
    """Event time from the first column that has a value, in seconds or milliseconds."""
    first = F.coalesce(*[F.col(c) for c in columns])
    out = df.withColumn("et", F.timestamp_seconds(first) if unit == "s" else event_time(first))
    return out.withWatermark("et", delay) if df.isStreaming and delay is not None else out


def with_list_time(df: DataFrame, items: str, field: str = "window_start_time", delay: str | None = None) -> DataFrame:
    """Event time from a field of a list's first element, in milliseconds."""
    out = df.withColumn("et", event_time(F.get(F.col(items), F.lit(0))[field]))
    return out.withWatermark("et", delay) if df.isStreaming and delay is not None else out


def tumble(df: DataFrame, size: str, keys: Sequence[str | Column], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by epoch-aligned window and keys."""
    return df.groupBy(F.window("et", size).alias("window"), *keys).agg(*aggregates)


def window_labels(df: DataFrame) -> DataFrame:
    """The window as text: start, end and date."""
    full = "yyyy-MM-dd HH:mm:ss"
    labels = [F.date_format("window.start", full).alias("stt"), F.date_format("window.end", full).alias("edt"), F.date_format("window.start", "yyyy-MM-dd").alias("cur_date")]
    return df.select(*labels, *[c for c in df.columns if c != "window"])


def cart_uu_window(first_adds: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Users who add to a cart for the first time that day, by window."""
    return window_labels(tumble(first_adds, size, [], [F.count("*").alias("cart_add_uu_ct")]))


def keyword_window(words: DataFrame, size: str = "10 seconds") -> DataFrame:
    return window_labels(tumble(words, size, ["keyword"], [F.count("*").alias("keyword_count")]))


def sku_order_window(detail: DataFrame, size: str = "5 seconds") -> DataFrame:
    """Amounts by sku and window; null amounts count as 0."""
    names = ("original_amount", "coupon_amount", "activity_amount", "total_amount")
    sums = [F.sum(F.coalesce(F.col(c).cast(MONEY), F.lit(0).cast(MONEY))).alias(c) for c in names]
    return window_labels(tumble(detail, size, ["sku_id"], sums))


def province_order_window(detail: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Amount and distinct orders by province and window.

    A stream, which must run in append mode, sums up orders first: so no state
    holds a set of orders, and a province with very many is spread over tasks.
    """
    total = F.sum(F.col("total_amount").cast(MONEY)).alias("total")
    if not detail.isStreaming:
        return window_labels(tumble(detail, size, ["province_id"], [total, F.count_distinct("order_id").alias("order_count")]))
    orders = tumble(detail, size, ["province_id", "order_id"], [total])
    out = orders.groupBy(F.window("window", size).alias("span"), "province_id").agg(F.sum("total").cast("decimal(26,2)").alias("total"), F.count("order_id").alias("order_count"))
    return window_labels(out.withColumnRenamed("span", "window"))


#: Bits of an order sketch's size: 16,384 registers in at most 16 KB, standard error 1.04 / 128 or 0.8 %.
SKETCH_BITS = 14


def order_sketch_window(detail: DataFrame, size: str) -> DataFrame:
    """Amount and a mergeable sketch of the distinct orders by province and window.

    A state of bounded size whatever the number of orders; ``merge_order_sketches`` makes longer windows of
    them without another look at the details.
    """
    total = F.sum(F.col("total_amount").cast(MONEY)).alias("total")
    return tumble(detail, size, ["province_id"], [total, F.hll_sketch_agg("order_id", SKETCH_BITS).alias("orders")])


def merge_order_sketches(windows: DataFrame, size: str) -> DataFrame:
    """Windows of ``order_sketch_window`` as windows of a multiple of their size, with the estimated number of distinct orders."""
    merged = windows.groupBy(F.window("window.start", size).alias("span"), "province_id").agg(
        F.sum("total").cast("decimal(26,2)").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("orders")).alias("order_count")
    )
    return window_labels(merged.withColumnRenamed("span", "window"))


def enrich_province(df: DataFrame, provinces: DataFrame) -> DataFrame:
    return enrich(df, provinces, "province_id", "id", {"name": "province_name"})


def traffic_window(visits: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Page views, unique visitors, sessions and duration by area, channel, version and new-user mark."""
    sums = [F.count("*").alias("pv"), F.sum("uv").alias("uv"), F.sum("sv").alias("sv"), F.sum("during_time").alias("dur")]
    return window_labels(tumble(visits, size, ["ar", "ch", "vc", "is_new"], sums))


def late_rows(df: DataFrame, batch: str, size_s: int, delay_s: int) -> DataFrame:
    """Batch form of lateness: rows a stream that reads the batches in order would drop.

    A row is late if its window ends at or before the watermark its batch is
    filtered by, the greatest event time up to two batches back less the delay.
    The watermark table has one row a batch.
    """
    from pyspark.sql.window import Window

    top = df.groupBy(batch).agg(F.max("et").alias("top"))
    order = Window.orderBy(batch)
    marks = top.select(F.lead(batch, 2).over(order).alias(batch), F.max("top").over(order).alias("seen")).filter(F.col(batch).isNotNull())
    mark = F.col("seen") - F.expr(f"interval {delay_s} seconds")
    end = F.window("et", f"{size_s} seconds").end
    late = F.coalesce(end <= mark, F.lit(False))
    return df.join(marks, batch, "left").withColumn("late", late).drop("seen")
