"""Histogram gradient-boosted trees over document statistics.

The model is fitted on at most ``sample`` labelled documents of the table (those whose
hashed ids come first; of rows that share an id one stands for all), binned to ``BINS``
quantile bins, one complete tree of fixed depth a round. Trees are flattened into arrays and traversed for whole batches:
node i's children are 2i + 1 and 2i + 2, so a level is one gather and compare.

Defined results
* null and empty texts are scored from zero statistics
* null ``doc_id`` counts as training side; it has no label, so it is only scored
* without labelled rows every score is 0.5; with one class only, its share
* repeated rows are each scored; labels that contradict count as 1 if their mean is 0.5 or more
* labels of absent documents take no place in the sample
* an empty table gives no rows; more columns in the inputs are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.ship import ship
from .docstats import NAMES, doc_stats
from .textblock import arrow_bytes, slices, trimmed

SAMPLE = 20_000
BINS = 64
CUT = 0.7


@dataclass
class Trees:
    """``feature`` and ``threshold`` by tree and inner node, ``leaf`` by tree and leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, smooth: float = 2.0, least: float = 4.0) -> Trees:
    """Boost on logistic loss; a node splits where the histogram gain is largest."""
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return none
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    at = binned + np.arange(m) * BINS
    total = np.full(n, none.base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, start = 2**level, 2**level - 1
            cell = ((node - start)[:, None] * (m * BINS) + at).ravel()
            shape = (width, m, BINS)
            g = np.bincount(cell, np.repeat(gradient, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(weight, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all**2 / (h_all + smooth)
            gain[(h < least) | (h_all - h < least)] = -1
            for j in range(width):
                f, b = divmod(int(gain[j].argmax()), BINS)
                if gain[j, f, b] > 1e-6 and b < len(edges[f]):
                    feature[start + j], threshold[start + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        end = node - inner
        g, h = np.bincount(end, gradient, leaves), np.bincount(end, weight, leaves)
        leaf = rate * g / (h + smooth)
        total += leaf[end]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(none.base, np.array(features), np.array(thresholds), np.array(values))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(0))
        for a, b in slices(offsets):
            base = offsets[a]
            x = doc_stats(data[base : offsets[b]], offsets[a : b + 1] - base)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a).cast(pa.float64()), flat], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on the labelled training rows, ``sample`` at most: a bounded table of figures."""
    ship(docs.sparkSession)
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # labels without a document take no place in the sample
    there = docs.select("doc_id").join(usable, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "quality")  # at most ``sample`` ids
    rows = known.mapInArrow(trimmed(_features), "doc_id long, quality double, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
    y = (rows.column("quality").to_numpy() >= 0.5).astype(np.float64)
    return fit(x, y)


def score(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(batch.schema.get_field_index("text")))
            parts = [np.zeros(0)]
            for a, b in slices(offsets):
                base = offsets[a]
                parts.append(shared.value.score(doc_stats(data[base : offsets[b]], offsets[a : b + 1] - base)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents, unchanged, that the classifier accepts."""
    column = "quality_score"
    while column in docs.columns:
        column += "_"
    return score(docs, train(docs, labels), column).filter(F.col(column) >= cut).drop(column)
