"""Ordered operators by key: first visits, new-user marks, session starts.

The batch forms order rows by (ts, id), which is total. Their streaming forms
are in ``tideline.streaming.state``; both give the same rows for input in that
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ts_to_date


def first_of_day(df: DataFrame, key: str, ts: str, row_id: str, flag: str = "first_of_day", before: Sequence[str] = ()) -> DataFrame:
    """1 where the row's date differs from the key's row before, else 0; ``ts`` is in milliseconds. Columns in ``before`` order rows first."""
    day = ts_to_date(ts)
    last = F.lag(ts).over(Window.partitionBy(key).orderBy(*before, ts, row_id))
    return df.withColumn(flag, F.when(last.isNull() | (ts_to_date(last) != day), 1).otherwise(0))


def fix_is_new(df: DataFrame, device: str, is_new: str, ts: str, row_id: str, before: Sequence[str] = ()) -> DataFrame:
    """Correct the new-user mark: only rows of the device's first day keep '1'.

    The first row sets the device's anchor: its own date if marked new, else the
    day before; later rows marked new on another date become '0'.
    """
    window = Window.partitionBy(device).orderBy(*before, ts, row_id).rowsBetween(Window.unboundedPreceding, 0)
    day = ts_to_date(ts)
    anchor = F.first(F.when(F.col(is_new) == "1", day).otherwise(ts_to_date(F.col(ts) - 86_400_000))).over(window)
    return df.withColumn("_anchor", anchor).withColumn(is_new, F.when((F.col(is_new) == "1") & (day != F.col("_anchor")), "0").otherwise(F.col(is_new))).drop("_anchor")


def session_start(last_page: Column | str) -> Column:
    c = F.col(last_page) if isinstance(last_page, str) else last_page
    return F.when(F.coalesce(c == "", F.lit(True)), 1).otherwise(0)


def returning_user(df: DataFrame, key: str, ts: str, row_id: str, gap_days: int = 7, flag: str = "returning") -> DataFrame:
    """1 where the key's row before lies more than ``gap_days`` days back."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, row_id))
    days = F.datediff(ts_to_date(ts).cast("date"), ts_to_date(before).cast("date"))
    return df.withColumn(flag, F.when(days > gap_days, 1).otherwise(0))
