"""Versions, upserts, deletes and retractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import negate


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation: at most one row a key and task is shuffled."""
    return _best(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, likewise."""
    return _best(df, keys, order, F.min_by)


def _best(df: DataFrame, keys: list[str], order: list[str], by: Callable[[Column, Column], Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(df.columns)


def upsert_latest(df: DataFrame, keys: list[str], order: list[str], op: str | None = None) -> DataFrame:
    """What an upsert sink holds: the last row of each key, unless that deletes."""
    last = latest(df, keys, order)
    return last.filter(F.col(op) != "d") if op else last


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same by ranking, for orders that sort both ways; every version is shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def delete_by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def apply_dim_changes(changes: DataFrame, columns: list[str]) -> DataFrame:
    """State of a dimension after puts and deletes (row_key, op, seq, cells map).

    A put writes its non-empty cells only; a delete removes the row. So a cell
    holds the last non-empty value after the row's last delete.
    """
    gone = changes.groupBy("row_key").agg(F.max(F.when(F.col("op") == "d", F.col("seq"))).alias("gone"))
    puts = changes.filter("op <> 'd'").join(gone, "row_key").filter("gone is null or seq > gone")
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    filled = [F.max_by(cell(c), F.when(F.coalesce(cell(c) != "", F.lit(False)), F.col("seq"))).alias(c) for c in columns]
    return puts.groupBy("row_key").agg(*filled)


def _next_to(df: DataFrame, keys: list[str], order: list[str], measures: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_old", F.lag(F.struct("*")).over(window))


def retract_pairs(df: DataFrame, keys: list[str], order: list[str], measures: list[str], ttl_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """Each version of a key, preceded by the version it replaces with measures negated.

    Sums over the result are sums over the latest versions. With ``ttl_ms`` a
    version is only retracted by one that follows within that time. ``sign`` is
    -1 for retractions. Null measures count as 0.
    """
    old = F.col("_old")
    follows = old.isNotNull()
    if ttl_ms is not None:
        follows = follows & (F.col(ts) - old[ts] <= ttl_ms)
    value = lambda src, c, flip: (negate(src[c]) if flip else F.coalesce(src[c], F.lit(0).cast("decimal(16,2)"))) if c in measures else src[c]
    rows = _next_to(df, keys, order, measures).select(F.struct(*[F.col(c) for c in df.columns]).alias("_now"), follows.alias("_follows"), "_old")
    cur, prev = F.col("_now"), F.col("_old")
    plus = F.struct(*[value(cur, c, False).alias(c) for c in df.columns], F.lit(1).alias("sign"))
    minus = F.struct(*[value(prev, c, True).alias(c) for c in df.columns], F.lit(-1).alias("sign"))
    both = F.when(F.col("_follows"), F.array(minus, plus)).otherwise(F.array(plus))
    return rows.select(F.explode(both).alias("r")).select("r.*")


def changelog_rows(df: DataFrame, outer: list[str]) -> DataFrame:
    """The rows a streaming left join emits: unmatched first, then withdrawn, then joined.

    ``outer`` are the columns of the right side; a row without match is only
    inserted. ``sign`` tells insertion from withdrawal.
    """
    matched = F.coalesce(*[F.col(c).cast("string") for c in outer]).isNotNull()
    bare = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c in outer else F.col(c) for c in df.columns]
    row = lambda cols, step, sign: F.struct(*cols, F.lit(step).alias("step"), F.lit(sign).alias("sign"))
    full = [F.col(c) for c in df.columns]
    steps = F.when(matched, F.array(row(bare, 0, 1), row(bare, 1, -1), row(full, 2, 1))).otherwise(F.array(row(full, 0, 1)))
    return df.select(F.explode(steps).alias("r")).select("r.*")
