"""A corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.line_dedup import line_filter
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_dedup
from millrace.llm.packing import pack
from millrace.llm.quality import quality_filter
from millrace.llm.shared import discard, settle

CONTEXT = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that loses all its lines stays, with an empty text."""
    return line_filter(docs, length_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in token sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), CONTEXT)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenising is not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of the folder. A stage's table is deleted when the next one's is written; the last one's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
