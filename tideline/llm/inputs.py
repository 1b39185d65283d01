"""Input tables and files of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The public tokenizer's file; a parameter of the operators that need it.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
