"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where none is set."""
    path = spark.conf.get(_KEY, None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tideline-shared-")
        spark.conf.set(_KEY, path)
    return path


class Scratch:
    """Tables written by one operator call, under one folder of their own.

    A table that is written and read again cuts the lineage: losing an
    executor later costs no recomputation. ``clear`` removes the folder once
    the results that depend on it have been written.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tideline-{what}-{uuid.uuid4().hex}"
        self._n = 0
        _made.append(self)

    def keep(self, df: DataFrame, name: str = "t", compression: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_all() -> None:
    """Remove the folders of all calls so far; their results must have been written."""
    while _made:
        _made.pop().clear()
