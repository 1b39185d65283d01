"""Words of a text, as rows or as a SQL table function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: runs of CJK characters, or of letters and digits.
RUNS = r"[一-龥]+|[\p{L}\p{N}&&[^一-龥]]+"
_CJK = r"^[一-龥]{2,}$"


def words(text: Column | str) -> Column:
    """Lowered runs of letters and digits; a run of two or more CJK characters gives its bigrams."""
    t = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(RUNS), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(_CJK), pairs(r)).otherwise(F.array(r))))


def split_words(df: DataFrame, text: str, word: str = "word") -> DataFrame:
    """One row a word; a text without words gives none."""
    return df.withColumn(word, F.explode(words(text)))


def register(spark: SparkSession, name: str = "split_words") -> None:
    """The same rule as a table function for SQL's lateral joins; it is inlined into the query, no Python runs."""
    pairs = "transform(sequence(1, greatest(length(r) - 1, 1)), i -> substr(r, i, 2))"
    runs = f"regexp_extract_all(lower(coalesce(text, '')), r'{RUNS}', 0)"
    each = f"transform({runs}, r -> CASE WHEN r RLIKE r'{_CJK}' THEN {pairs} ELSE array(r) END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word STRING) RETURN SELECT explode(flatten({each}))")
