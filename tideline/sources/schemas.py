"""Declared types at the edges."""

from __future__ import annotations

from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

_MAP = MapType(StringType(), StringType())

CDC = StructType(
    [
        StructField("source", _MAP),
        StructField("op", StringType()),
        StructField("ts_ms", LongType()),
        StructField("after", _MAP),
        StructField("before", _MAP),
    ]
)
PAGE_LOG = StructType([StructField("common", _MAP), StructField("page", _MAP), StructField("ts", LongType())])
RULE = StructType([StructField(c, StringType()) for c in ("source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key")])
