"""Semantic-cache memory as a table: id, query, query_embedding,
retrieved_docs, answer, answer_embedding, timestamp. Lookups are joins on the
id chosen by routing; similarity breakdowns are column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Provider, embed
from ..functions.vectors import as_double, cosine

MEMORY_DDL = ("id long, query string, query_embedding array<float>, retrieved_docs array<string>, "
              "answer string, answer_embedding array<float>, timestamp string")
# Timestamp format of memory entries and log rows.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def empty_memory(spark) -> DataFrame:
    return spark.createDataFrame([], MEMORY_DDL)


def similarity_breakdown(rows: DataFrame, memory: DataFrame, provider: Provider | None = None,
                         seq: str = "seq", qvec: str = "qvec", memory_id: str = "memory_id") -> DataFrame:
    """(seq, sim_answer, sim_docs) for rows that matched a memory entry:
    cosine of the query with the stored answer embedding, and the mean cosine
    with the embeddings of the stored documents (null without documents).
    Stored documents are embedded once per distinct text."""
    m = rows.filter(F.col(memory_id).isNotNull()).select(seq, qvec, memory_id)
    mem = memory.select(F.col("id").alias(memory_id), "answer_embedding", "retrieved_docs")
    j = m.join(mem, memory_id, "left")
    sim_a = j.select(seq, F.when(F.col("answer_embedding").isNotNull(),
                                 cosine(qvec, as_double("answer_embedding"))).alias("sim_answer"))
    docs = j.select(seq, qvec, F.explode("retrieved_docs").alias("doc"))
    doc_vecs = embed(docs.select("doc").distinct(), "doc", provider, "dvec")
    sim_d = (docs.join(doc_vecs, "doc").groupBy(seq)
             .agg(F.avg(cosine(qvec, "dvec")).alias("sim_docs")))
    return sim_a.join(sim_d, seq, "left")


def new_memory_entries(stored: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Rows (stored_id, query, qvec, docs, answer) -> memory entries; the
    answer is embedded with the same provider as the queries."""
    e = embed(stored, "answer", provider, "avec")
    return e.select(F.col("stored_id").alias("id"), "query",
                    F.transform("qvec", lambda x: x.cast("float")).alias("query_embedding"),
                    F.col("docs").alias("retrieved_docs"), "answer",
                    F.transform("avec", lambda x: x.cast("float")).alias("answer_embedding"),
                    F.date_format(F.current_timestamp(), TS_FORMAT).alias("timestamp"))
