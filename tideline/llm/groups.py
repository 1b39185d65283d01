"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches cut where a key changes, and whether a cut begins a new run.

    Nulls are a key of their own. A run may come in several pieces, so what a
    caller holds of it is its own choice.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            codes = batch.column(batch.schema.get_field_index(key)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        value = lambda i, b=batch: tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)
        new[0] = last is None or last != value(0)
        last = value(batch.num_rows - 1)
        starts = np.flatnonzero(new)
        edges = np.unique(np.concatenate([[0], starts, [batch.num_rows]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield bool(new[a]), batch.slice(a, b - a)
