"""Fact joins, lookups and dimension enrichment. All are equi joins.

The joins of facts take batches and streams. Rows of two streams also have to be
close in event time (``meet``), so a stream of changes brings a watermark on ``et``.

Dimensions are joined without a broadcast hint: Spark's own size check picks a
broadcast for a small one and a shuffle for a large one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount, ms_string_to_date
from .cdc import KEY, carried, cdc_fact, status_changed_to, time_of

DETAIL = "id order_id sku_id sku_name create_time source_id source_type sku_num order_price split_total_amount split_activity_amount split_coupon_amount".split()
REFUND = "id user_id order_id sku_id refund_type refund_num refund_amount refund_reason_type refund_reason_txt create_time".split()
PAYMENT = "id order_id sku_id payment_type callback_time total_amount".split()


def _near(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, before: str, after: str, how: str) -> DataFrame:
    r = right.withColumnsRenamed({k: f"_{k}" for k in on})
    same = [F.col(k) == F.col(f"_{k}") for k in on]
    start, end = F.col(left_time) - F.expr(f"interval {before}"), F.col(left_time) + F.expr(f"interval {after}")
    return left.join(r, [*same, F.col(right_time) >= start, F.col(right_time) <= end], how).drop(*[f"_{k}" for k in on])


def meet(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", gap: str = "15 minutes") -> DataFrame:
    """Join by equal names. Rows of two streams, or of micro-batches, must be at most ``gap`` apart in event time.

    So Spark can drop rows from the state, and a left join gives a row without
    match once the watermark is past its gap. The left row's time is kept. Rows that have a
    log's key meet only with the same one.
    """
    on = [on] if isinstance(on, str) else list(on)
    if KEY in left.columns and KEY in right.columns:
        on.append(KEY)
    times = [*time_of(left), *time_of(right)]
    if len(times) < 2 or times[0] != times[1]:
        return left.join(right, on, how)
    return _near(left, right.withColumnRenamed(times[1], "_et"), on, times[0], "_et", gap, gap, how).drop("_et")


def detail_with_order(detail: DataFrame, orders: DataFrame) -> DataFrame:
    """Order details with their order's user and province."""
    o = orders.select(F.col("id").alias("order_id"), "user_id", "province_id", *carried(orders))
    return meet(detail.filter("id is not null"), o, "order_id")


def with_activity(detail: DataFrame, activity: DataFrame) -> DataFrame:
    a = activity.filter("order_detail_id is not null").select(F.col("order_detail_id").alias("id"), "activity_id", "activity_rule_id", *carried(activity))
    return meet(detail, a, "id", "left")


def with_coupon(detail: DataFrame, coupon: DataFrame) -> DataFrame:
    c = coupon.filter("order_detail_id is not null").select(F.col("order_detail_id").alias("id"), "coupon_id", *carried(coupon))
    return meet(detail, c, "id", "left")


def order_detail(cdc: DataFrame) -> DataFrame:
    """The wide trade fact: 17 columns of text, as the envelopes hold them; a stream's rows carry ``et`` too."""
    detail = cdc_fact(cdc, "order_detail", DETAIL)
    orders = cdc_fact(cdc, "order_info", ["id", "user_id", "province_id"])
    activity = cdc_fact(cdc, "order_detail_activity", ["order_detail_id", "activity_id", "activity_rule_id"])
    coupon = cdc_fact(cdc, "order_detail_coupon", ["order_detail_id", "coupon_id"])
    if cdc.isStreaming:
        wide = with_coupon(with_activity(detail_with_order(detail, orders), activity), coupon)
    else:  # orders last: the fact stays dealt out by order, for joins by it that follow
        wide = detail_with_order(with_coupon(with_activity(detail, activity), coupon), orders)
    return wide.select(
        "id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id",
        ms_string_to_date("create_time").alias("date_id"), "create_time", "sku_num",
        amount("sku_num", "order_price").cast("decimal(33,4)").cast("string").alias("split_original_amount"),
        "split_activity_amount", "split_coupon_amount", "split_total_amount", "ts_ms", *time_of(wide),
    )


def lookup_join(df: DataFrame, dictionary: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """A dictionary's name for a code; rows of unknown codes go, unless ``how`` is left."""
    d = dictionary.select(F.col("dic_code").alias(key), F.col("info.dic_name").alias(name))
    return df.join(d, key, how)


def order_refund(cdc: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refund requests of orders that became refundable, with both code names."""
    refund = cdc_fact(cdc, "order_refund_info", REFUND)
    orders = status_changed_to(cdc, "order_info", "order_status", "1005", ["id", "province_id"]).withColumnRenamed("id", "order_id").drop("ts_ms")
    wide = lookup_join(meet(refund, orders, "order_id"), dictionary, "refund_type", "refund_type_name")
    wide = lookup_join(wide, dictionary, "refund_reason_type", "refund_reason_type_name")
    return wide.select(
        "id", "user_id", "order_id", "sku_id", "province_id", ms_string_to_date("create_time").alias("date_id"), "create_time",
        "refund_type", "refund_type_name", "refund_reason_type", "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount", "ts_ms", *time_of(wide),
    )


def refund_success(cdc: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refund payments that succeeded, with the refund's quantity and the payment type's name."""
    paid = status_changed_to(cdc, "refund_payment", "refund_status", "1602", PAYMENT)
    refund = cdc_fact(cdc, "order_refund_info", ["order_id", "sku_id", "refund_num"]).drop("ts_ms")
    orders = status_changed_to(cdc, "order_info", "order_status", "1006", ["id", "user_id", "province_id"])
    orders = orders.withColumnRenamed("id", "order_id").drop("ts_ms")
    wide = lookup_join(meet(meet(paid, refund, ["order_id", "sku_id"]), orders, "order_id"), dictionary, "payment_type", "payment_type_name")
    return wide.select(
        "id", "user_id", "order_id", "sku_id", "province_id", "payment_type", "payment_type_name", ms_string_to_date("callback_time").alias("date_id"),
        "callback_time", "refund_num", F.col("total_amount").alias("refund_amount"), "ts_ms", *time_of(wide),
    )


def enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str], how: str = "inner") -> DataFrame:
    """Columns of a dimension by key; ``columns`` maps its names to new ones."""
    d = dim.select(F.col(dim_key).alias(key), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(d, key, how)


Step = tuple[DataFrame, str, str, dict[str, str]]


def flatten_dims(steps: Sequence[Step]) -> DataFrame:
    """A snowflake chain as one dimension: each step joins on a column an earlier one gave."""
    first, key, dim_key, columns = steps[0]
    out = first.select(F.col(dim_key).alias(key), *[F.col(c).alias(n) for c, n in columns.items()])
    for dim, k, dk, cols in steps[1:]:
        out = enrich(out, dim, k, dk, cols, "left")
    return out


def enrich_chain(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Enrich by a chain of dimensions, flattened first so that the facts are joined once."""
    return df.join(flatten_dims(steps), steps[0][1])


def flag_members(df: DataFrame, column: str, words: DataFrame, word: str = "word", flag: str = "flagged") -> DataFrame:
    """Is the value in the set? Null and empty values are not."""
    known = words.filter(F.col(word).isNotNull() & (F.col(word) != "")).select(F.col(word).alias(column)).distinct().withColumn("_in", F.lit(True))
    return df.join(known, column, "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_in")


def order_cancel(cdc: DataFrame, wide: DataFrame) -> DataFrame:
    """Details of orders cancelled before payment."""
    gone = status_changed_to(cdc, "order_info", "order_status", "1003", ["id"], before="1001").select(F.col("id").alias("order_id"), F.col("ts_ms").alias("cancel_ts_ms"))
    return wide.join(gone, "order_id")


def within(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, before_ms: int = 900_000, after_ms: int = 5_000) -> DataFrame:
    """Interval join: right rows from ``before_ms`` before to ``after_ms`` after the left row.

    Time is cut into buckets as wide as the interval, so a left row's lies in one or two of
    them and it is copied to these; a right row has one. The join is by key and bucket: no
    pair of rows further apart than two buckets is made, and a hot key is spread over time.
    """
    width = max(1, before_ms + after_ms)
    first, last = (F.floor((F.col(left_ts) + gap) / width) for gap in (-before_ms, after_ms))
    spread = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    gap: Column = F.col(right_ts) - F.col(left_ts)
    met = spread.join(right.withColumn("_bucket", F.floor(F.col(right_ts) / width)), [on, "_bucket"])
    return met.filter((gap >= -before_ms) & (gap <= after_ms)).drop("_bucket")


def comments(cdc: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Comments with the name of their grade."""
    rows = cdc_fact(cdc, "comment_info", ["id", "user_id", "sku_id", "appraise"])
    return lookup_join(rows, dictionary, "appraise", "appraise_name")


def within_streams(
    left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, before: str = "15 minutes", after: str = "5 seconds", delay: str = "10 seconds", how: str = "inner"
) -> DataFrame:
    """Interval join of two streams on event times; the bounds and watermarks let Spark drop old state.

    ``how`` may be left: rows without a match come out once the watermark passes their interval.
    """
    return _near(left.withWatermark(left_time, delay), right.withWatermark(right_time, delay), [on], left_time, right_time, before, after, how)
