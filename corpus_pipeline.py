"""Corpus preparation: toxicity, line dedup, near-dedup and packing, each stage on what the one before it kept.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are treated as each stage's operator says. A verdict
stays with its row, whatever other rows have the same doc_id or none. Rows without a score of 0.7 stay; line dedup edits texts and
drops no row; of a group of near copies the row of the least doc_id stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpoint
from quern.llm.linededup import dedup_lines
from quern.llm.minhash import without_near_copies
from quern.llm.packing import pack
from quern.llm.toxicity import learn_by_key, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model is learned from the labels of rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, learn_by_key(docs, labels), others=docs.columns).where("score < 0.7").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one, and their new lengths."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return pack(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: The first stage learns a model and the last packs ids: neither is SQL. Tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        # else each action of a stage would run the stages before it again
        docs = stage(spark, checkpoint(docs) if i else docs, sf_dir)
    return docs
