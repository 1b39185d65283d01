"""Tables that streams change: folders committed once a batch, and upserts by bucket.

Both put data down first and make it visible by one atomic rename, so a crash in
between changes nothing and a replayed batch finds what it did before. The file
system has to rename atomically (HDFS, local disks; not plain object stores), and
a table has one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """The few file operations that commits need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def sizes(self, path: str) -> dict[str, int]:
        return {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._path(path))} if self.exists(path) else {}

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        """Give a finished file or folder its name; fails if the name is taken."""
        if self.exists(new):
            raise FileExistsError(new)
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """A small file, whole or not at all."""
        staged = f"{path.rpartition('/')[0]}/_staged-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(staged), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.rename(staged, path)


def commit_batch(df: DataFrame, path: str, batch_id: int, *partition_by: str | None, form: str = "parquet", compression: str | None = None) -> bool:
    """Add a batch's rows as the folder ``batch=N``, once: a batch that is there already is left as it is.

    The folders are the ledger, so it lasts as long as the rows. A stream that reads
    the path sees whole batches only, and a replay gives it no new files.
    """
    files = Files(df.sparkSession, path)
    folder = f"{path}/batch={batch_id}"
    if files.exists(folder):
        return False
    staged = f"{path}/_staged/{batch_id}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*[c for c in partition_by if c]).format(form)
    (writer.option("compression", compression) if compression else writer).save(staged)
    files.rename(staged, folder)
    files.delete(f"{path}/_staged")
    return True


def committed(spark: SparkSession, path: str) -> set[int]:
    """Batches in a folder."""
    return {int(n.removeprefix("batch=")) for n in Files(spark, path).names(path) if n.startswith("batch=")}


@dataclass(frozen=True)
class Version:
    """A table at one time: its files by bucket. Bounded by the number of buckets."""

    number: int
    batch: int
    schema: str | None
    buckets: dict[int, list[str]]


class BucketTable:
    """Rows by key, copied on write a bucket at a time.

    A key's hash picks its bucket. A batch rewrites the buckets that its keys fall into;
    the next version is a small file list that names the new files of those and the old
    files of all others. Choose ``n_buckets`` so that a bucket is a task's work; it
    stays as it was when the table was made. With ``keep`` each batch removes all but so
    many versions, so a stream that runs for ever keeps a bounded number of them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], n_buckets: int = 64, keep: int | None = None):
        if keep is not None and keep < 2:
            raise ValueError("a batch that is tried again needs the version before")
        self.spark, self.path, self.keys, self.n_buckets, self.keep = spark, path, keys, n_buckets, keep
        self.files = Files(spark, path)

    def bucket(self, *keys: Any) -> Any:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names(f"{self.path}/versions") if not n.startswith("_")]

    def version(self, number: int | None = None) -> Version:
        """A version's file list, the latest unless told otherwise; an empty one if there is none."""
        there = self.versions()
        if not there or number == 0:
            return Version(0, -1, None, {})
        held = json.loads(self.files.read(f"{self.path}/versions/{number or there[-1]:010d}.json"))
        if held["keys"] != self.keys:
            raise ValueError(f"{self.path} has the keys {held['keys']}")
        self.n_buckets = held["n_buckets"]
        return Version(held["number"], held["batch"], held["schema"], {int(k): v for k, v in held["buckets"].items()})

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first."""
        return self._rows(self.version(number))

    def read_near(self, rows: DataFrame, columns: list[str], number: int | None = None) -> DataFrame | None:
        """A version's rows in the buckets that keys in ``columns`` of ``rows`` fall into, so all that those keys can meet.

        The columns are the table's keys in order, whatever their names and types there.
        """
        if len(columns) != len(self.keys):
            raise ValueError(f"{self.path} has the keys {self.keys}")
        version = self.version(number)
        if version.schema is None:
            return None
        schema = StructType.fromJson(json.loads(version.schema))
        keys = [F.col(c).try_cast(schema[k].dataType) for c, k in zip(columns, self.keys, strict=True)]
        near = rows.select(self.bucket(*keys).alias("b")).distinct().collect()  # at most n_buckets
        return self._rows(version, [r.b for r in near])

    def _rows(self, version: Version, only: list[int] | None = None) -> DataFrame | None:
        if version.schema is None:
            return None
        schema = StructType.fromJson(json.loads(version.schema))
        names = [f"{self.path}/{f}" for b, fs in version.buckets.items() if only is None or b in only for f in fs]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: int, merged: Callable[[DataFrame | None, DataFrame], DataFrame]) -> bool:
        """The next version: ``merged`` gives the new rows of the buckets that the batch touches from their old rows and the batch.

        A batch that the table has seen changes nothing. ``merged`` gets at most one row a key
        if the batch has, so nothing but the batch itself and the touched buckets is read.
        """
        now = self.version()
        if batch_id <= now.batch:
            return False
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most n_buckets
        if not touched and now.schema:
            self._commit(Version(now.number + 1, batch_id, now.schema, now.buckets))
            return True
        rows = merged(self._rows(now, touched), batch)
        folder = f"data/{uuid.uuid4().hex}"
        spread = rows.withColumn("_bucket", self.bucket()).repartition(max(1, len(touched)), "_bucket")
        spread.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        new = {b: [f"{folder}/_bucket={b}/{n}" for n in self.files.names(f"{self.path}/{folder}/_bucket={b}")] for b in touched}
        buckets = {**now.buckets, **new}
        self._commit(Version(now.number + 1, batch_id, json.dumps(rows.schema.jsonValue()), {b: fs for b, fs in buckets.items() if fs}))
        return True

    def _commit(self, v: Version) -> None:
        text = json.dumps({"number": v.number, "batch": v.batch, "schema": v.schema, "keys": self.keys, "n_buckets": self.n_buckets, "buckets": v.buckets})
        self.files.write_once(f"{self.path}/versions/{v.number:010d}.json", text)
        if self.keep:
            self.vacuum(self.keep)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last versions, and data that none of those names."""
        there = self.versions()
        for number in there[:-keep]:
            self.files.delete(f"{self.path}/versions/{number:010d}.json")
        used = {f for number in there[-keep:] for fs in self.version(number).buckets.values() for f in fs}
        for folder in self.files.names(f"{self.path}/data"):
            for bucket in self.files.names(f"{self.path}/data/{folder}"):
                if not any(f.startswith(f"data/{folder}/{bucket}/") for f in used):
                    self.files.delete(f"{self.path}/data/{folder}/{bucket}")
