"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, gbt, html, maxent, neardup, packing, repair, rules, secrets, sharding, trie
from .inputs import table, tokenizer_path


def op2_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op1_lemma_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_turns(table(spark, sf_dir, "conversations"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lemma_decontamination": op1_lemma_decontamination,
    "op2_virtual_slot_shards": op2_virtual_slot_shards,
    "op3_maxent_scores": op3_maxent_scores,
    "op4_secret_forest": op4_secret_forest,
    "op5_block_extraction": op5_block_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_tiered_packing": op7_tiered_packing,
    "op8_tool_call_linking": op8_tool_call_linking,
    "op9_chosen_path_dedup": op9_chosen_path_dedup,
    "op10_boosted_quality": op10_boosted_quality,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_fingerprints": op12_prefix_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op11_structure_repair": repair.SQL,
    "op13_prefix_trie": trie.SQL,
    "op6_quality_rules": rules.sql(),
    "op8_tool_call_linking": chat.TURNS_SQL,
    "op9_chosen_path_dedup": neardup.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
