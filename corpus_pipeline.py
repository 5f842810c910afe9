"""The training-data pipeline: ``run(spark, sf_dir)`` takes ``documents`` through the
stages below, in order; each stage's rows are written as Parquet to the shared
checkpoint folder and read again as the next one's input. All stages but the last
return the columns of documents.

Rows with a null or empty text have no words, so the first stage rejects them; an
empty table passes all stages and gives no pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkrecall.llm import exact_dedup, packing, quality, simhash, substring_dedup
from sparkrecall.session import cut_lineage, table

SEQUENCE_TOKENS, END_ID = 2048, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail."""
    return quality.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages found in an earlier document are cut; every document stays."""
    return substring_dedup.dedup_substrings(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, SEQUENCE_TOKENS)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("substring_dedup", substrings), ("packing", packed)]

#: SimHash, chunking and the tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = cut_lineage(rows)
    return rows
