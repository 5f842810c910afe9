"""Registered queries: pruned and approximate neighbours, the keyed cache, untyped
samples, needle tables, first-n selections, fallbacks, run files and error summaries,
over the driver's tables (whole tables, whole texts)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import embed
from ..functions.text import bm25_tokens
from ..functions.vectors import as_double
from ..operators.generate import LLM_ERROR
from ..operators.memory import similarity_breakdown
from ..operators.needles import query_metrics_table
from ..operators.pivots import pivot_knn
from ..operators.projections import projected_knn
from ..operators.samples import select_questions, smoke_corpus
from ..operators.scoring import capture_errors, evaluate_predictions
from ..operators.telemetry import MEMORY, RETRIEVAL, interpretation_notes, phase_summary, run_summary
from ..operators.untyped import explode_untyped_evidence
from ..operators.vector_index import load_or_rebuild
from ..session import cut_lineage, ensure_checkpoint_dir, table
from ..sources import writers as W
from ..sources.readers import read_flat_summaries
from .corpus import build_corpus
from .queries import TEST_THRESHOLD, _r, _stream_folder, _stream_ordered_batches, conversation_pairs, events_log
from .reports import write_roll_up
from .sample_queries import nested_samples

# Questions selected; characters of a long document; conversations whose generator fails (every n-th).
FIRST_QUESTIONS, LONG_CHARS, FAILS_EVERY = 100, 30_000, 7


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", as_double("embedding").alias("vec"), F.col("label").alias("cache_key"))


def knn_pivot_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    nn = pivot_knn(e, e, 5, qid="vec_id", cid="vec_id", exclude_self=True, cell_rows=512)
    return nn.select(F.col("query_id").alias("vec_id"), "rank", F.col("doc_id").alias("nn_id"), _r("dist").alias("dist"))


def knn_projected_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: the rows whose id is divisible by 100 search all rows."""
    e = _vectors(spark, sf_dir)
    nn = projected_knn(e.where("vec_id % 100 = 0"), e, 5, qid="vec_id", cid="vec_id", exclude_self=True, bucket_rows=128)
    return nn.select(F.col("query_id").alias("vec_id"), "rank", F.col("doc_id").alias("nn_id"), _r("dist").alias("dist"))


def memory_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the memory of three runs: the index is made for the first two, opened
    again for all three, and searched for the nearest two entries of every row."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index/{uuid.uuid4().hex}"
    memory = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec").alias("query_embedding"),
                                            (F.col("vec_id") % 3).cast("string").alias("run_id"))
    load_or_rebuild(memory.where("run_id != '2'"), path)
    found = load_or_rebuild(memory, path).nearest(_vectors(spark, sf_dir), 2, qid="vec_id")
    return found.select(F.col("query_id").alias("vec_id"), "rank", F.col("doc_id").alias("nn_id"), _r("similarity").alias("similarity"))


def stream_keyed_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache with one state per label, over three micro-batches."""
    from ..streaming.keyed_cache import streaming_keyed_cache
    folder = _stream_folder(spark)
    _stream_ordered_batches(_vectors(spark, sf_dir).withColumnRenamed("vec_id", "seq"), "seq", folder, lambda stream: streaming_keyed_cache(
        stream, "cache_key", f"{folder}/out", f"{folder}/ckpt", TEST_THRESHOLD))
    return spark.read.parquet(f"{folder}/out").select(
        F.col("seq").alias("vec_id"), F.col("key").alias("cache_key"), "source", "memory_id", _r("confidence").alias("confidence"), "stored_id")


def untyped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested samples as JSON text; must give what the typed ones give."""
    s = nested_samples(spark, sf_dir).select("pos", F.to_json(F.struct("context", "search_results", "evidence")).alias("json"))
    return explode_untyped_evidence(s, "json")


def turns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a routing log: the text is the query, the assistant's turns come from memory."""
    c = table(spark, sf_dir, "conversations")
    n = F.char_length(F.coalesce("text", F.lit("")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("query"), F.lit(None).cast("timestamp").alias("timestamp"),
                    F.when(F.col("role") == "assistant", F.lit(MEMORY)).otherwise(F.lit(RETRIEVAL)).alias("source"),
                    ((n % 97) / 97.0).alias("confidence"), (n / 7.0).alias("latency"), F.col("turn").alias("memory_size"),
                    F.col("turn").alias("retrieval_count"), F.col("turn").alias("memory_count"))


def needle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the benchmark as a needle over the turns."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(bm25_tokens("text")).alias("needle"))
    m = query_metrics_table(turns_log(spark, sf_dir), words)
    return m.select("query", "matches", _r("avg_confidence").alias("avg_confidence"), _r("max_confidence").alias("max_confidence"),
                    _r("avg_latency").alias("avg_latency"), _r("min_latency").alias("min_latency"), "memory", "retrieval", "other",
                    "latest_source", _r("latest_latency").alias("latest_latency"), "latest_memory_size")


def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid questions, answers as given, the last id passing even when empty."""
    q = select_questions(nested_samples(spark, sf_dir), FIRST_QUESTIONS, variant="as_given", id_variant="last_passes")
    q = W.joined_aliases(q)
    return q.select("pos", "query_id", "question", "answer_value", "aliases", F.size("answer_aliases").cast("long").alias("num_aliases"))


def smoke_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke_corpus(nested_samples(spark, sf_dir))


def long_document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents as the corpus; where they are under twenty, the benchmark texts join them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    return build_corpus(docs, questions=asked, min_text_len=LONG_CHARS, question_min_len=20).chunks


def memory_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against a stored benchmark item: its answer's and its lines' similarity."""
    b = table(spark, sf_dir, "benchmark")
    memory = embed(b.select(F.col("item_id").alias("id"), "text", F.split("text", "\n").alias("retrieved_docs")), "text", out_col="answer_embedding")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    rows = embed(turns, "text", out_col="qvec").withColumn("memory_id", F.when(F.col("seq") % 3 != 0, F.col("seq") % 211))
    s = similarity_breakdown(cut_lineage(rows.select("seq", "qvec", "memory_id")), memory)
    return s.select("seq", F.round("sim_answer", 4).alias("sim_answer"), F.round("sim_docs", 4).alias("sim_docs"))


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns scored against the turn before, with a generator that fails on some: captured
    errors, summaries over valid rows."""
    fails = F.col("rid.conv_id") % FAILS_EVERY == 0
    pairs = conversation_pairs(spark, sf_dir).withColumn("prediction", F.when(fails, F.lit(f"{LLM_ERROR} TimeoutError: no answer")).otherwise(F.col("prediction")))
    scored = evaluate_predictions(pairs, "rid", with_rouge=False).join(pairs.select("rid", F.col("prediction").alias("generated_answer")), "rid")
    rows = scored.select((F.col("rid.conv_id") % 3).alias("run_id"), (F.col("rid.conv_id") * 1000 + F.col("rid.turn")).alias("seq"), "generated_answer", "em",
                         "f1", "answer_contains_gold", (F.col("rid.turn") / 10.0).alias("confidence"), F.lit(0.5).alias("latency_s"),
                         F.when(F.col("rid.conv_id") % 2 == 0, F.lit(MEMORY)).otherwise(F.lit(RETRIEVAL)).alias("source"))
    s = phase_summary(capture_errors(rows, limit=24), "phase2", smoke_size=10)
    return s.select("run_id", "phase", "smoke_size", "total_queries", "error_count", "num_questions", _r("avg_em").alias("avg_em"),
                    F.round("avg_f1", 4).alias("avg_f1"), _r("avg_confidence").alias("avg_confidence"), "memory_path_count", "retrieval_path_count",
                    _r("hallucination_rate").alias("hallucination_rate"), F.round("memory_path_avg_f1", 4).alias("memory_path_avg_f1"))


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event type: its summary files are written, found again, rolled up,
    and the roll-up's CSV is read back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    log = events_log(spark, sf_dir).withColumn("run_id", F.col("query")).withColumnRenamed("latency", "latency_s")
    s = cut_lineage(interpretation_notes(run_summary(log, final_memory_size=True)).withColumns({"dataset": F.lit("events"), "threshold": F.lit(0.55)}))
    for r in s.select("run_id").orderBy("run_id").collect():   # the runs, one per event type
        run = s.where(F.col("run_id") == r.run_id)
        W.write_summary(run.drop("notes"), f"{base}/{r.run_id}/summary_metrics.json", f"{base}/{r.run_id}/summary_metrics.csv")
    write_roll_up(spark, base)
    back = read_flat_summaries(spark, [f"{base}/roll_up/all_runs.csv"])
    return back.select("run_id", "dataset", F.col("num_questions").cast("long").alias("num_questions"),
                       *[_r(F.col(c).cast("double")).alias(c) for c in ("avg_confidence", "avg_latency_s", "memory_path_rate", "retrieval_path_rate")],
                       F.col("final_memory_size").cast("long").alias("final_memory_size"))


REGISTRY = {f.__name__: f for f in (
    knn_pivot_embeddings, knn_projected_embeddings, memory_index_search, stream_keyed_routing, untyped_evidence, needle_metrics, first_questions, smoke_documents,
    long_document_corpus, memory_breakdown, error_summary, run_files)}
