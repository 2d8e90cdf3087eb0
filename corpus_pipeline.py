"""The corpus pipeline: stages that each call one operator, run one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm import language, packing, personal_data, quality, registry, simhash
from orograph.llm.common import durable, reachable, table, unused


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and texts without a letter go.

    A document without ``lang`` gets the language told. Where no document has a
    label nothing can be told apart, and every text with a letter stays.
    """
    reachable(spark)
    parser = language.fit(docs)
    if not parser.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = unused("lang_", docs.columns)
    told = language.identify(docs, parser, keep=True, names=(own + "pred", own + "score"))
    told = told.where(F.col(own + "pred") != language.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", own + "pred")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Documents without an id, and rows repeated under one id, stay.
    """
    groups = simhash.near_copies(docs)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced in their texts, and their lengths as they are then."""
    field = personal_data.fit(personal_data.labelled_table(spark))
    return personal_data.redacted(docs, field).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.packed_documents(docs, registry.BYTE_BPE)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Language, personal data and packing are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each over what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = durable(docs)
    return docs
