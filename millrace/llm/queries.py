"""The thin queries of the numbered operators: whole tables, production parameters."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import oracles
from millrace.llm.chain_dedup import passages
from millrace.llm.line_dedup import line_dedup
from millrace.llm.main_text import main_text
from millrace.llm.mixing import taken
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.quality import quality
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.token_alignment import alignment
from millrace.llm.token_count import token_counts
from millrace.llm.topk import top_k
from millrace.llm.vector_codes import compress, with_label_errors
from millrace.llm.warc import archive

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The two tokenizers that are aligned.
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CONTEXT = 2048


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), VOCABULARY, CONTEXT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = archive(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), VOCABULARY, CONTEXT)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the remaining text goes along, so that what was removed can be seen from the result itself
    return substring_dedup(read(spark, sf_dir, "documents"), 400, keep_first=False).withColumnRenamed("kept", "kept_text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read(spark, sf_dir, "embeddings"), 8, 16, 6, 4096.0)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    columns = ["id AS vec_id", "lower(hex(code)) AS code", "error", "label_error", f"'{digest}' AS codebooks_sha256"]
    return with_label_errors(codes).selectExpr(*columns)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_chain_dedup": op2_chain_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_exact_topk": op5_exact_topk,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_main_text": op12_main_text,
    "op13_vector_codes": op13_vector_codes,
}

#: Token counts and alignment, packing, the mixture's hashes, 400-byte windows and pages are tested against brute force instead.
ORACLES = {
    "op1_near_dedup": oracles.OP1,
    "op4_warc": oracles.OP4,
    "op5_exact_topk": oracles.OP5,
    "op6_quality_rules": oracles.OP6,
    "op7_line_dedup": oracles.OP7,
    "op13_vector_codes": oracles.OP13,
}
