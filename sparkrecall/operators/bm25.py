"""Okapi BM25 as tables: term counts per document and an equi-join scorer.

Scoring starts from the queries: their terms meet the vocabulary first (a small
join), and only then the term counts, so only postings of asked terms are weighted
and only documents sharing a term are touched (inverted-index evaluation)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..session import bucketed_table, cut_lineage

# Okapi BM25 parameters and the negative-idf floor factor.
K1 = 1.5
B = 0.75
EPSILON = 0.25
# Characters of text per bucket of the term-count table.
BUCKET_CHARS = 256 << 20


@dataclass
class Bm25Index:
    tf: DataFrame        # doc_id, dl, term, tf; bucketed by doc_id
    terms: DataFrame     # term, df, idf
    docs: DataFrame      # doc_id, dl
    avgdl: float
    k1: float = K1
    b: float = B


def build_bm25(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
               k1: float = K1, b: float = B, epsilon: float = EPSILON, buckets: int | None = None) -> Bm25Index:
    """Build the index tables.

    Texts are hash-partitioned by document once (a shuffle of the raw chunks);
    tokenising, exploding and counting tf then stay inside each partition (the
    aggregation's distribution is already satisfied), and tf is stored as a
    table bucketed by document -- the layout the scorer wants. The number of
    buckets grows with the text. The vocabulary (df, idf) is one aggregation
    over tf; N, avgdl and the mean idf are one-row actions whose values enter
    the plans as literals."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_b = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    toks = rows.repartition(n_b, "doc_id").select("doc_id", bm25_tokens("text").alias("toks"))
    # explode_outer keeps a null-term row for a document without tokens, so it
    # still counts in N and avgdl.
    tf = (toks.select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
          .groupBy("doc_id", "dl", "term").agg(F.count("term").alias("tf")))
    tf = bucketed_table(tf, "doc_id", n_b, prefix="bm25_tf")
    docs = tf.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    st = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = int(st["n"]), float(st["avgdl"] or 0.0)
    tf = tf.filter(F.col("term").isNotNull())
    raw = cut_lineage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                      .withColumn("raw_idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean_idf = raw.agg(F.avg("raw_idf")).first()[0] or 0.0
    terms = raw.select("term", "df", F.when(F.col("raw_idf") < 0, F.lit(epsilon * mean_idf))
                       .otherwise(F.col("raw_idf")).alias("idf"))
    return Bm25Index(tf, terms, docs, avgdl, k1, b)


def query_terms(queries: DataFrame, qid_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term, qtf): token bag of each query with multiplicity."""
    return (queries.select(F.col(qid_col).alias("query_id"), F.explode(bm25_tokens(text_col)).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def weighted_terms(index: Bm25Index, queries: DataFrame, qid_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """Written table (query_id, term, qw): query terms of the vocabulary with
    qtf * idf. Its size on disk decides whether Spark broadcasts it to the term
    counts or shuffles both."""
    q = query_terms(queries, qid_col, text_col).join(index.terms.select("term", "idf"), "term")
    return cut_lineage(q.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qw")))


def score_terms(index: Bm25Index, terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25) from ``weighted_terms``. ``only`` (query_id, doc_id):
    score just these pairs -- the term counts are first cut to their documents."""
    tf = index.tf
    if only is not None:
        tf = tf.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    tfc = F.col("tf").cast("double")
    norm = F.lit(index.k1) * (F.lit(1 - index.b) + F.lit(index.b) * F.col("dl")
                              / F.lit(index.avgdl if index.avgdl > 0 else 1.0))
    hits = tf.join(terms, "term")
    if only is not None:
        hits = hits.join(only.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    return hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("qw") * tfc * (index.k1 + 1) / (tfc + norm)).alias("bm25"))


def bm25_scores(index: Bm25Index, queries: DataFrame, qid_col: str = "query_id", text_col: str = "query",
                only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25) for every document sharing a term with the query."""
    return score_terms(index, weighted_terms(index, queries, qid_col, text_col), only)
