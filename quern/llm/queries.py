"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _file("piece_bpe_32k.model"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode, read_ranks

    ranks = _file("byte_bpe_multi_50k.tiktoken")
    d = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), read_ranks(ranks)), 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_edited, distinct_count, to_string

    d = compare_edited(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", "edited_sha256", to_string(F.col("sketch")).alias("fingerprint"), to_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", distinct_count(F.col("sketch")).alias("n_distinct"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    d = extract(table(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "template_size")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "text", F.col("_removed").cast("long").alias("n_removed"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, learn_by_key, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn_by_key(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_fingerprint": op4_fingerprint,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_html_text": op6_html_text,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_vector_dedup": op10_vector_dedup,
}
ORACLES: dict[str, str] = {}
