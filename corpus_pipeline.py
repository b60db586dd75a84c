"""Five stages from raw documents to packed training sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet in the shared folder and read again as the next stage's documents, so
a lost executor costs no more than one stage. All stages but the last return the
columns of ``documents``, whatever they are, and may meet columns with any names.

What a stage decides about a row depends on its text, or on a key that is given
to each row, never on its id alone: ids may be missing or stand in several rows.

* toxicity: a null text is scored as an empty one; rows of equal texts share
  their fate; without labels of both kinds the fixed grammar decides.
* near_copies: of each group of copies and near copies the row with the least id
  stays, of rows that share it the first; a row without an id stays only if none
  of the group has one; rows without a word all stay.
* decontamination: rows without a text, or of fewer than five words, hold no
  item; items without an id or a text are left out.
* secrets: all rows stay; a null text stays null, and ``n_chars`` follows a text
  that was masked.
* packing: a null text is an empty one, which is a piece of one token; repeated
  rows are packed each.

Very long texts are read whole in every stage, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assetlake.llm import common, decontamination, jaccard_join, packing, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot score by a fitted grammar or pack; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
