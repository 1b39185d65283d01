"""Projections, filters and routing of change envelopes and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.schemas import PAGE_LOG
from .changelog import latest


def entry(column: str, key: str) -> Column:
    """An entry of a map, null if missing. Of a map that a query builds itself, Catalyst keeps only the value asked for."""
    return F.col(column)[key]


def table_of(cdc: DataFrame) -> Column:
    """The source table's name: a plain column where the stream has one, so that filters prune files and branches."""
    return F.col("source_table") if "source_table" in cdc.columns else entry("source", "table")


def of_table(cdc: DataFrame, table: str, ops: tuple[str, ...] = ("c",)) -> DataFrame:
    return cdc.filter((table_of(cdc) == table) & F.col("op").isin(*ops))


#: Event time of the rows of a micro-batch, whose joins are held to it as those of streams are.
BATCH_TIME = "batch_et"


def time_of(df: DataFrame) -> list[str]:
    """The event time that rows of a stream or a micro-batch carry on; other batches need none."""
    name = "et" if df.isStreaming else BATCH_TIME
    return [name] if name in df.columns else []


#: Key that rows which meet have in common, as messages of a partitioned log do: dealt out by it once, they meet without another shuffle.
KEY = "source_key"


def carried(df: DataFrame) -> list[str]:
    """The event time and the key that rows carry on."""
    return [*time_of(df), *([KEY] if KEY in df.columns else [])]


def cdc_fact(cdc: DataFrame, table: str, columns: list[str], ops: tuple[str, ...] = ("c",)) -> DataFrame:
    """Named entries of ``after`` as columns, and the source's ``ts_ms``."""
    return of_table(cdc, table, ops).select(*[entry("after", c).alias(c) for c in columns], entry("source", "ts_ms").alias("ts_ms"), *carried(cdc))


def status_changed_to(cdc: DataFrame, table: str, column: str, value: str, columns: list[str], before: str | None = None) -> DataFrame:
    """Updates that carry an old value and end at ``value``; from ``before`` only, if given."""
    old = entry("before", column)
    hit = of_table(cdc, table, ("u",)).filter(old.isNotNull() & (entry("after", column) == value))
    if before is not None:
        hit = hit.filter(old == before)
    return hit.select(*[entry("after", c).alias(c) for c in columns], entry("source", "ts_ms").alias("ts_ms"), *carried(cdc))


def cart_add(cdc: DataFrame, table: str = "cart_info") -> DataFrame:
    """Quantities put into carts: of new rows, and what larger quantities add; all else goes."""
    now, old = entry("after", "sku_num").try_cast("int"), entry("before", "sku_num").try_cast("int")
    added = F.when(F.col("op") == "c", now).otherwise(now - old)
    hit = of_table(cdc, table, ("c", "u")).filter((F.col("op") == "c") | (now > old))
    return hit.select(
        *[entry("after", c).alias(c) for c in ("id", "user_id", "sku_id")], added.alias("sku_num"), entry("source", "ts_ms").try_cast("bigint").alias("ts")
    )


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def split_valid_json(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that hold a JSON object, and all others."""
    good = _is_object(F.col(value))
    return lines.filter(good), lines.filter(~good)


def parse_or_drop(lines: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    good, _ = split_valid_json(lines, value)
    return good.select(F.from_json(value, schema).alias("j")).select("j.*")


def parse_or_fail(lines: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """As ``parse_or_drop``, but a bad line fails the query."""
    return lines.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def unwrap_log(cdc: DataFrame, table: str = "z_log") -> DataFrame:
    """Page logs carried as JSON text in ``after.log``."""
    return of_table(cdc, table, ("c", "r")).select(F.from_json(entry("after", "log"), PAGE_LOG).alias("j")).select("j.*")


def with_field(logs: DataFrame, field: str = "page") -> DataFrame:
    return logs.filter(F.col(field).isNotNull())


def search_keywords(pages: DataFrame) -> DataFrame:
    """Items searched for: ``item`` and event milliseconds."""
    page = lambda k: entry("page", k)
    hit = (page("last_page_id") == "search") & page("item").isNotNull() & (page("item_type") == "keyword")
    return pages.filter(hit).select(page("item").alias("keyword"), "ts")


def current_rules(rule_cdc: DataFrame, key: str = "source_table") -> DataFrame:
    """The rules in force: the last envelope of each key, unless it deletes."""
    row = F.coalesce("after", "before")
    keyed = rule_cdc.withColumn("rule", row).withColumn("rule_key", F.try_element_at(row, F.lit(key)))
    last = latest(keyed.filter("rule_key is not null"), ["rule_key"], ["ts_ms", "seq"]).filter("op <> 'd'")
    names = ("source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key")
    return last.select(*[F.try_element_at("rule", F.lit(n)).alias(n) for n in names])


def with_rules(cdc: DataFrame, rules: DataFrame) -> DataFrame:
    """All rows with their table's rule, ``ruled`` where there is one: one join.

    The rules describe tables, one row each, and are far below any broadcast
    limit; Spark's own size check decides, so a larger table is shuffled.
    """
    named = cdc.withColumn("source_table", table_of(cdc))
    return named.join(rules.withColumn("ruled", F.lit(True)), "source_table", "left")


def split_by_rules(routed: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``with_rules`` that have a rule, with it; and the rest without its columns."""
    own = [c for c in rules.columns if c != "source_table"]
    return routed.filter("ruled").drop("ruled"), routed.filter("ruled is null").drop("ruled", *own)


def route_by_rules(cdc: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose table has a rule, with the rule; and the rest."""
    return split_by_rules(with_rules(cdc, rules), rules)


def route_facts(cdc: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts by (table, op): the row before a delete, after anything else, with ``ts``; snapshot rows go."""
    named = cdc.filter("op <> 'r'").withColumn("source_table", table_of(cdc))
    data = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return named.join(rules, ["source_table", "op"]).select("source_table", "op", "sink_topic", data.alias("data"), F.col("ts_ms").alias("ts"))


def project_sink_columns(dim: DataFrame, row: str = "after", columns: str = "sink_columns") -> DataFrame:
    """Only the entries that the rule names."""
    wanted = F.transform(F.split(columns, ","), F.trim)
    return dim.withColumn(row, F.map_filter(row, lambda k, _: F.array_contains(wanted, k)))


def drop_empty_cells(cells: Column | str) -> Column:
    return F.map_filter(cells, lambda _, v: F.coalesce(v != "", F.lit(False)))


def rows_to_json(df: DataFrame) -> DataFrame:
    """Each row as JSON by column name, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
