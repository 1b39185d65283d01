"""Sources, as batch and streaming DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import camel_columns, event_time
from .schemas import CDC


def read_lines(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Text lines in a column ``value``, from files."""
    if not stream:
        return spark.read.text(path)
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


#: Kafka's numbers for the ends of a partition.
EDGES = {"latest": -1, "earliest": -2}

Offsets = str | int | Mapping[str, Mapping[int, int | str]]


def topic_options(servers: str, topics: str | Sequence[str], start: Offsets = "earliest", end: Offsets | None = None, per_trigger: int | None = None, min_parts: int | None = None) -> dict[str, str]:
    """Options of a Kafka read.

    ``start`` and ``end`` are ``earliest`` or ``latest``, a time in milliseconds, or offsets by topic
    and partition, each a number or one of the two words. A range with an ``end`` is a batch read.
    ``min_parts`` splits large partitions over tasks, ``per_trigger`` bounds a stream's batches.
    """
    names = [topics] if isinstance(topics, str) else list(topics)
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(names)}
    for side, at in (("starting", start), ("ending", end)):
        if at is None:
            continue
        if isinstance(at, str):
            if at not in EDGES or (side, at) == ("ending", "earliest"):
                raise ValueError(f"{side} offsets cannot be {at!r}")
            out[f"{side}Offsets"] = at
        elif isinstance(at, int):
            out[f"{side}Timestamp"] = str(at)
        else:
            if set(at) - set(names):
                raise ValueError(f"offsets of topics that are not read: {sorted(set(at) - set(names))}")
            out[f"{side}Offsets"] = json.dumps({t: {str(p): EDGES.get(o, o) for p, o in sorted(ps.items())} for t, ps in at.items()})
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    if min_parts:
        out["minPartitions"] = str(min_parts)
    return out


def read_topic(spark: SparkSession, servers: str, topics: str | Sequence[str], start: Offsets = "earliest", end: Offsets | None = None, **options: int) -> DataFrame:
    """Values of Kafka topics as text, a stream or, with an ``end``, a batch; needs Spark's Kafka package on the cluster."""
    reader = (spark.readStream if end is None else spark.read).format("kafka").options(**topic_options(servers, topics, start, end, **options))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_table(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Parquet files, as a table or as a stream of files."""
    batch = spark.read.parquet(path)
    if not stream:
        return batch
    reader = spark.readStream.schema(batch.schema)
    # as a pattern, a path may name one file as well as a directory
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def read_json_table(lines: DataFrame, schema: StructType, value: str = "value", ms: str | None = None) -> DataFrame:
    """JSON lines as typed columns, with event time ``et`` from a millisecond column; bad lines are all null."""
    out = lines.select(F.from_json(value, schema).alias("j")).select("j.*")
    return out.withColumn("et", event_time(ms)) if ms else out


def read_cdc(lines: DataFrame, value: str = "value", entries: Sequence[str] | None = None) -> DataFrame:
    """Change envelopes: source, op, ts_ms, after, before, event time ``et`` and ``source_table``.

    Partition stored change tables by ``source_table``: a fact then reads its own files only.
    Of a reader that names its ``entries`` only these are parsed, into structs in place of the maps; all
    else in a line is passed over.
    """
    schema = CDC
    if entries is not None:
        of = lambda names: StructType([StructField(n, StringType()) for n in names])
        taken = {"source": of(["table", "ts_ms"]), "after": of(entries), "before": of(entries)}
        schema = StructType([StructField(f.name, taken.get(f.name, f.dataType)) for f in CDC])
    rows = read_json_table(lines, schema, value, "ts_ms")
    return rows.withColumn("source_table", F.try_element_at("source", F.lit("table")) if entries is None else F.col("source.table"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_dim(df: DataFrame, key: str, columns: list[str], family: str = "info") -> DataFrame:
    """A dimension as key and one nested column family."""
    return df.select(key, F.struct(*columns).alias(family))


def query_options(url: str, sql: str, split: tuple[str, object, object, int] | None = None) -> dict[str, str]:
    """Options of a JDBC read; ``split`` is (column, lower, upper, parts), read by as many tasks."""
    if split is None:
        return {"url": url, "query": sql}
    column, lower, upper, parts = split
    bounds = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
    return {"url": url, "dbtable": f"({sql}) q"} | bounds  # Spark splits tables only, not queries


def query_bounds(spark: SparkSession, url: str, sql: str, column: str, parts: int, **options: str) -> tuple[str, object, object, int] | None:
    """How to split a query by a column: its least and greatest value, which the database finds. None if there is none."""
    ends = f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM ({sql}) q"
    row = spark.read.format("jdbc").options(**query_options(url, ends), **options).load().first()
    return None if row is None or row[0] is None else (column, row[0], row[1], parts)


def read_query(
    spark: SparkSession, url: str, sql: str, camel_names: bool = False, split: tuple[str, object, object, int] | None = None, by: str | None = None, parts: int | None = None, **options: str
) -> DataFrame:
    """Rows of a JDBC query; needs the database's driver on the cluster.

    ``split`` has the bounds of a column to read by; ``by`` names the column alone, whose bounds
    are then asked for, and is read by ``parts`` tasks, one a core unless told otherwise. Rows whose
    value is null or beyond the bounds are read too. Without either one task reads all.
    """
    if by is not None:
        split = query_bounds(spark, url, sql, by, parts or spark.sparkContext.defaultParallelism, **options)
    df = spark.read.format("jdbc").options(**query_options(url, sql, split), **options).load()
    return camel_columns(df) if camel_names else df


def scan_limit(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key, each as JSON with ``row_key`` added."""
    first = df.orderBy(key).limit(n)
    return first.select(F.col(key).alias("row_key"), F.to_json(F.struct(F.col(key).cast("string").alias("row_key"), *[c for c in df.columns if c != key])).alias("json"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def point_lookup(df: DataFrame, key: str, keys: Iterable | DataFrame) -> DataFrame:
    """Rows of given keys: a pushed-down filter for a list, a semi join for a table of keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    return df.filter(F.col(key).isin(*keys))
