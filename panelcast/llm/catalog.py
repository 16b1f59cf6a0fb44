"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import conversations, decontaminate, html_text, merkle, minhash, mixing, multi_index, oracles, pii, repeats, rules, sharding, token_orc, toxicity
from panelcast.llm.common import read
from panelcast.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def op1_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(read(spark, folder, "pages"))


def op3_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


def op4_suffix_array_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeated_passages(read(spark, folder, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(spans, ","))


def op5_histogram_sort_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


def op6_multi_index_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_duplicates(read(spark, folder, "embeddings"))


def op7_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(read(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_orc.token_report(spark, path)


def op8_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, read(spark, folder, "labels")))


def op9_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(read(spark, folder, "documents"))


def op10_semi_crf_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return pii.personal_data(documents, pii.fit(documents))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audited(read(spark, folder, "conversations"))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return rules.score(documents, rules.fit(documents, read(spark, folder, "labels")))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        op1_qgram_decontamination,
        op2_html_main_text,
        op3_minhash_near_duplicates,
        op4_suffix_array_repeats,
        op5_histogram_sort_shards,
        op6_multi_index_near_duplicates,
        op7_token_orc,
        op8_toxicity_scores,
        op9_source_mixture,
        op10_semi_crf_personal_data,
        op11_conversation_repair,
        op12_quality_rules,
        op13_merkle_manifest,
    ]
}
ORACLE: dict[str, str] = {
    "op3_minhash_near_duplicates": oracles.OP3,
    "op4_suffix_array_repeats": oracles.OP4,
    "op5_histogram_sort_shards": oracles.OP5,
    "op6_multi_index_near_duplicates": oracles.OP6,
    "op9_source_mixture": oracles.OP9,
    "op11_conversation_repair": oracles.OP11,
    "op13_merkle_manifest": oracles.OP13,
}
