"""The registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm import (exact_dedup, html_text, licenses, line_dedup, packing, quality, resampling, sampled_pieces, simhash,
                             substring_dedup, token_files, toxicity, whitening)
from sparkrecall.session import spread, table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    rows = sampled_pieces.sample_pieces(docs, public_tokenizers.path(PIECE_BPE), seed=7)
    return rows.withColumn("ids", F.array_join("ids", " "))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_table(docs, public_tokenizers.path(WORD_BPE), end_id=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.digest_rows(table(spark, sf_dir, "documents"))
    return exact_dedup.classify(rows).select("doc_id", "keep_id", "group_size", "kept",
                                             F.lower(F.hex("digest")).alias("text_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_verdicts(spread(table(spark, sf_dir, "documents")))
    return rows.withColumn("dropped", F.array_join("dropped", ","))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spread(table(spark, sf_dir, "pages")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, count="n_cut_words")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(spread(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(WORD_BPE), end_id=1)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


REGISTRY = {f.__name__: f for f in (
    op1_sampled_pieces, op2_token_files, op3_exact_dedup, op4_simhash_near_dedup, op5_line_dedup, op6_html_text,
    op7_substring_dedup, op8_license_scan, op9_quality_rules, op10_packing,
    op11_embedding_whitening, op12_toxicity, op13_importance_resampling, pipeline)}
