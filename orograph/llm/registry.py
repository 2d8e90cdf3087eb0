"""Queries over the document tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orograph.llm import chat, clustering, language, mixing, neighbours, packing, personal_data, prefix_trie, quality, sentence_pieces, sharding, simhash, urls
from orograph.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op3_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = language.fit(docs.where(~language.held_out()))
    return language.identify(docs, parser).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(table(spark, sf_dir, "documents"), PIECE_BPE, digests=True)


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = personal_data.fit(personal_data.labelled_table(spark))
    return personal_data.found(table(spark, sf_dir, "documents"), field)


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op13_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE_SQL: dict[str, str] = {
    "op8_snapshot_collapse": chat.ORACLE,
    "op9_quality_cascade": quality.ORACLE,
    "op10_path_templates": urls.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_weighted_lloyd": clustering.ORACLE,
    "op13_fair_queueing": mixing.ORACLE,
}
