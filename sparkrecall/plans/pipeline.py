"""End-to-end question answering with a semantic cache, for a whole table of
questions at once (no per-question driver loop):

  guard -> embed questions once -> routing fixpoint (hits / misses) ->
  hybrid retrieval for misses -> prompts -> generation (one mapInPandas) ->
  new memory entries -> hits served from the memory (their own or this
  batch's stored answers; a hit on an empty answer generates from the stored
  documents and is not stored) -> similarity breakdown -> running counters ->
  log rows -> scores against gold aliases -> per-run summary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Provider, embed
from ..functions.text import has_alnum, py_strip
from ..operators.bm25 import Bm25Index, build_bm25, score_terms, weighted_terms
from ..operators.generate import Generator, extractive_generator, generate_answers, is_error, raise_first_error
from ..operators.hybrid import BM25_WEIGHT, DENSE_WEIGHT, dense_scores, hybrid_top_k
from ..operators.knn import knn
from ..operators.memory import empty_memory, new_memory_entries, similarity_breakdown
from ..operators.ordering import running_sums
from ..operators.prompts import build_prompt
from ..operators.routing import THRESHOLD, route_decisions
from ..operators.scoring import capture_errors, evaluate_predictions
from ..operators.telemetry import MEMORY, RETRIEVAL, interpretation_notes, run_summary
from ..session import cut_lineage


@dataclass
class RetrievalIndex:
    chunks: DataFrame    # chunk_id, text
    vectors: DataFrame   # chunk_id, vec
    bm25: Bm25Index


def build_index(chunks: DataFrame, provider: Provider | None = None) -> RetrievalIndex:
    """Materialise the chunk table, its vectors and the BM25 index once."""
    c = cut_lineage(chunks.select("chunk_id", "text"))
    vecs = cut_lineage(embed(c, "text", provider, "vec").select("chunk_id", "vec"))
    return RetrievalIndex(c, vecs, build_bm25(c))


def hybrid_retrieve(queries: DataFrame, index: RetrievalIndex, k: int = 3, bm25_weight: float = BM25_WEIGHT,
                    dense_weight: float = DENSE_WEIGHT, qid: str = "query_id", text: str = "query",
                    qvec: str = "qvec") -> DataFrame:
    """(query_id, rank, chunk_id, score) for a whole table of queries; the dense
    side fetches 2k exact neighbours per query."""
    q = queries.select(F.col(qid).alias("query_id"), F.col(text).alias("query"), F.col(qvec).alias("qvec"))
    parts, rescore = {}, None
    if bm25_weight:
        terms = weighted_terms(index.bm25, q)
        parts["bm25"] = score_terms(index.bm25, terms)

        def rescore(pairs):
            return score_terms(index.bm25, terms, only=pairs)
    if dense_weight:
        # dense candidates (2k per query) are read several times: materialise once
        nn = cut_lineage(knn(q, index.vectors, 2 * k, qid="query_id", qvec="qvec", cid="chunk_id", cvec="vec"))
        parts["dense"] = dense_scores(nn)
    top = hybrid_top_k(parts.get("bm25"), parts.get("dense"), q.select("query_id"),
                       index.chunks.select(F.col("chunk_id").alias("doc_id")), k, bm25_weight, dense_weight, rescore=rescore)
    return top.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score")


def retrieved_docs(top: DataFrame, index: RetrievalIndex) -> DataFrame:
    """(query_id, docs array<string>) in rank order."""
    j = top.join(index.chunks, "chunk_id")
    return j.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("docs"))


@dataclass
class RunResult:
    predictions: DataFrame
    memory: DataFrame       # preloaded + new entries
    new_memory: DataFrame   # entries stored by this run
    log: DataFrame
    summary: DataFrame
    rejected: DataFrame


def process_queries(questions: DataFrame, index: RetrievalIndex, *, threshold: float = THRESHOLD,
                    generate: Generator = extractive_generator, provider: Provider | None = None,
                    memory: DataFrame | None = None, run_id: str = "run", k: int = 3,
                    golds: str | None = "answer_aliases", on_error: str = "raise", store_errors: bool = False) -> RunResult:
    """``questions``: seq (arrival order), query_id, question [, answer_value, answer_aliases].
    ``memory``: preloaded entries; new ids follow the largest of theirs.
    ``on_error``: 'raise' or 'capture' (see ``evaluation.run_evaluation``). Entries whose
    answer is a generation error keep an empty answer, so a hit on one generates
    anew; ``store_errors`` stores the error text instead."""
    spark = questions.sparkSession
    memory = memory if memory is not None else empty_memory(spark)
    q = questions.withColumn("question", py_strip("question"))
    rejected = q.filter(~has_alnum("question"))
    q = cut_lineage(embed(q.filter(has_alnum("question")), "question", provider, "qvec"))
    n_pre = memory.agg(F.count(F.lit(1))).first()[0]

    routed = cut_lineage(route_decisions(q.select("seq", "qvec"), threshold, seq="seq", vec="qvec",
                                         preloaded=memory if n_pre else None))
    rows = q.join(routed, "seq")

    # misses: retrieve, prompt, generate, store
    miss = rows.filter(F.col("source") == RETRIEVAL)
    top = hybrid_retrieve(miss.select(F.col("seq").alias("query_id"), F.col("question").alias("query"), "qvec"),
                          index, k=k)
    miss = (miss.join(retrieved_docs(top, index).withColumnRenamed("query_id", "seq"), "seq", "left")
            .withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
            .withColumn("prompt", build_prompt("question", "docs")))
    miss = cut_lineage(generate_answers(miss, "prompt", generate))
    if on_error == "raise":
        raise_first_error(miss)
    stored_answer = F.col("answer") if store_errors else F.when(~is_error("answer"), F.col("answer")).otherwise(F.lit(""))
    new_mem = cut_lineage(new_memory_entries(miss.select("stored_id", F.col("question").alias("query"),
                                                         "qvec", "docs", stored_answer.alias("answer")), provider))
    all_mem = memory.unionByName(new_mem)

    # hits: serve the stored answer; an empty stored answer is regenerated (not stored)
    hit = (rows.filter(F.col("source") == MEMORY)
           .join(all_mem.select(F.col("id").alias("memory_id"), F.col("retrieved_docs").alias("docs"),
                                F.col("answer").alias("past")), "memory_id", "left"))
    served = hit.filter(F.coalesce("past", F.lit("")) != "").withColumn("answer", F.col("past")) \
                .withColumn("gen_latency_s", F.lit(0.0))
    regen = generate_answers(hit.filter(F.coalesce("past", F.lit("")) == "")
                             .withColumn("prompt", build_prompt("question", "docs", "past")), "prompt", generate)
    cols = ["seq", "query_id", "question", "qvec", "source", "memory_id", "confidence", "stored_id", "docs",
            "answer", "gen_latency_s"] + [c for c in (golds, "answer_value") if golds and c in questions.columns]
    out = miss.select(*cols).unionByName(served.select(*cols)).unionByName(regen.select(*cols))

    sims = similarity_breakdown(out.select("seq", "qvec", "memory_id"), all_mem, provider)
    out = out.join(sims, "seq", "left").withColumn("run_id", F.lit(run_id))
    out = running_sums(out, ["run_id"], ["seq"], {
        "retrieval_count": (F.col("source") == RETRIEVAL).cast("long"),
        "memory_count": (F.col("source") == MEMORY).cast("long")})
    out = cut_lineage(out.withColumn("memory_size", F.col("retrieval_count") + F.lit(n_pre)))
    if on_error == "raise":
        raise_first_error(out)

    log = out.select("seq", "run_id", F.current_timestamp().alias("timestamp"), F.col("question").alias("query"),
                     "confidence", "memory_id", F.when(F.col("memory_id").isNotNull(), F.col("confidence"))
                     .alias("sim_query"), "sim_answer", "sim_docs", "source",
                     F.col("gen_latency_s").alias("latency"), "memory_size", "retrieval_count", "memory_count")
    preds = out.select("seq", "run_id", "query_id", "question", F.col("answer").alias("generated_answer"),
                       "confidence", "source", "memory_id", F.col("gen_latency_s").alias("latency_s"), "memory_size",
                       "retrieval_count", "memory_count", *[c for c in (golds, "answer_value") if c in out.columns])
    if golds and golds in out.columns:
        scores = evaluate_predictions(preds.select("seq", "generated_answer", golds), "seq",
                                      "generated_answer", golds)
        answer = F.col("answer_value") if "answer_value" in preds.columns else F.get(F.col(golds), F.lit(0))
        preds = preds.join(scores, "seq").withColumn("correct_answer", answer)
        if on_error == "capture":
            preds = capture_errors(preds)
    summary = interpretation_notes(run_summary(preds, valid_only=on_error == "capture"))
    return RunResult(preds, all_mem, new_mem, log, summary, rejected)
