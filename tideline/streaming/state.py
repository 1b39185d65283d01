"""Stateful stream operators by key, with the semantics of their batch forms.

They run on ``transformWithState``: a key's rows come in bounded frames, its
state is a RocksDB value, and timers or a lifetime end it.

With a ``delay`` rows may arrive in any order within that time. They are held in
state, a packed chunk a slice of event time, and released in (ts, id) order by a
timer once the watermark has passed their slice: the result is that of the batch
form whatever the order of arrival, a task holds one slice of one key at a time,
and rows later than the delay are dropped by the watermark. Without a delay rows
count as they arrive, each frame ordered by (ts, id).

``ttl_ms`` lets a key's state lapse that long after its last write, in processing
time; Spark has lifetimes in that time only, so they go with the order of arrival.
Days are columns of the session's time zone, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import ts_to_date

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time that is released as one piece.
SLICE_MS = 86_400_000

#: From ordered rows and the held value (None: none yet) to rows and the new value.
Step = Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, tuple]]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _pack(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _AsTheyCome(StatefulProcessor):
    """Frames go through the step as they arrive."""

    def __init__(self, step: Step, held: str, names: list[str], order: list[str], ttl_ms: int | None = None):
        self.step, self.held_schema, self.names, self.order, self.ttl_ms = step, held, names, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.held_schema, *([self.ttl_ms] if self.ttl_ms else []))

    def stepped(self, frame: pd.DataFrame) -> pd.DataFrame:
        rows, value = self.step(frame.sort_values(self.order, kind="stable", ignore_index=True), self.held.get())
        self.held.update(value)
        return rows

    def named(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames under their columns' names; Spark gives those that begin with an underscore others."""
        return (frame.set_axis(self.names, axis=1) for frame in rows if len(frame))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in self.named(rows):
            yield self.stepped(frame)

    def close(self) -> None:
        pass


class _InOrder(_AsTheyCome):
    """Frames are put by until the watermark has passed their slice of event time."""

    def __init__(self, step: Step, held: str, names: list[str], order: list[str], slice_ms: int):
        super().__init__(step, held, names, order)
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.chunks = handle.getMapState("chunks", "slice long, n int", "rows binary")
        self.counts = handle.getMapState("counts", "slice long", "n int")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        set_for = self.timer.get()
        if set_for and set_for[0] <= at:
            return
        if set_for:
            self.handle.deleteTimer(set_for[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in self.named(rows):
            for piece, part in frame.groupby(frame[self.order[0]] // self.slice_ms):
                piece = int(piece)
                n = self.counts.getValue((piece,))[0] if self.counts.containsKey((piece,)) else 0
                self.chunks.updateValue((piece, n), (_pack(part),))
                self.counts.updateValue((piece,), (n + 1,))
                first = piece if first is None else min(first, piece)
        if first is not None:
            self._wake((first + 1) * self.slice_ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], v[0]) for k, v in self.counts.iterator())
        for piece, n in waiting:
            if (piece + 1) * self.slice_ms > passed:
                self._wake((piece + 1) * self.slice_ms)
                return
            yield self.stepped(pd.concat([_unpack(self.chunks.getValue((piece, i))[0]) for i in range(n)]))
            for i in range(n):
                self.chunks.removeKey((piece, i))
            self.counts.removeKey((piece,))


def _run(df: DataFrame, keys: list[str], step: Step, output: str, held: str, order: list[str], delay: str | None, ttl_ms: int | None, slice_ms: int) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if delay is None:
        return df.groupBy(*keys).transformWithStateInPandas(_AsTheyCome(step, held, df.columns, order, ttl_ms), output, "append", "ProcessingTime" if ttl_ms else "None")
    if ttl_ms is not None:
        raise ValueError("a state with a lifetime takes rows as they arrive: give no delay")
    timed = df.withColumn("_et", F.timestamp_millis(order[0])).withWatermark("_et", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(_InOrder(step, held, timed.columns, order, slice_ms), output, "append", "EventTime")


def first_of_day(df: DataFrame, key: str, ts: str, row_id: str, flag: str = "first_of_day", delay: str | None = None, slice_ms: int = SLICE_MS) -> DataFrame:
    """State: the date last seen. Marks rows whose date differs."""
    columns = [*df.columns, flag]

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        days = rows["_day"].tolist()
        rows[flag] = [int(d != p) for d, p in zip(days, [held[0] if held else None, *days[:-1]], strict=True)]
        return rows[columns], (days[-1],)

    return _run(df.withColumn("_day", ts_to_date(ts)), [key], step, f"{_fields(df)}, {flag} int", "day string", [ts, row_id], delay, None, slice_ms)


def fix_is_new(df: DataFrame, device: str, is_new: str, ts: str, row_id: str, delay: str | None = None, slice_ms: int = SLICE_MS) -> DataFrame:
    """State: the device's anchor date. Takes back the new mark on any other date."""
    columns = df.columns

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        anchor = held[0] if held else rows["_day"][0] if rows[is_new][0] == "1" else rows["_day_before"][0]
        rows.loc[(rows[is_new] == "1") & (rows["_day"] != anchor), is_new] = "0"
        return rows[columns], (anchor,)

    dated = df.withColumns({"_day": ts_to_date(ts), "_day_before": ts_to_date(F.col(ts) - 86_400_000)})
    return _run(dated, [device], step, _fields(df), "day string", [ts, row_id], delay, None, slice_ms)


def retract_pairs(df: DataFrame, keys: list[str], ts: str, row_id: str, measures: list[str], ttl_ms: int | None = None, delay: str | None = None, slice_ms: int = SLICE_MS) -> DataFrame:
    """State: the key's last row, emitted negated before its successor.

    Measures are integers here, such as cents; null counts as 0. With ``ttl_ms`` a row is
    only taken back by one that arrives within that time of the key's last write.
    """
    columns = df.columns

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = rows[columns]
        rows[measures] = rows[measures].fillna(0).astype("int64")
        if held:
            rows = pd.concat([pd.DataFrame([tuple(held)], columns=columns).astype(rows.dtypes), rows], ignore_index=True)
        at = np.arange(len(rows))
        # each row but the first is preceded by the one before it, negated
        both = np.stack([at - 1, at], axis=1).ravel()[1:] if not held else np.stack([at[:-1], at[1:]], axis=1).ravel()
        sign = np.tile([-1, 1], len(rows))[1:] if not held else np.tile([-1, 1], len(rows) - 1)
        out = rows.iloc[both].reset_index(drop=True)
        out[measures] = out[measures].mul(sign, axis=0)
        out["sign"] = sign
        last = rows.iloc[-1]
        return out, tuple(None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v for v in (last[c] for c in columns))

    return _run(df, keys, step, f"{_fields(df)}, sign int", _fields(df), [ts, row_id], delay, ttl_ms, slice_ms)
