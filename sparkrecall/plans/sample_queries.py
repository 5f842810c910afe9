"""Registered queries over nested samples, turns and runs that are derived from the
driver's tables (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens, has_alnum, is_valid_query, truncate_text
from ..operators.bm25 import build_bm25, score_terms, weighted_terms
from ..operators.hybrid import hybrid_top_k
from ..operators.samples import explode_evidence, select_questions
from ..operators.telemetry import best_run
from ..session import cut_lineage, ensure_checkpoint_dir, spread, table
from ..sources import writers as W
from ..sources.readers import LOG_V2_COLUMNS, read_log
from .corpus import build_corpus_from_samples, build_passage_corpus, documents_corpus
from .queries import _events_summary, _r, conversation_pairs, events_log

# Characters kept of a turn.
TURN_CHARS = 40


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a nested QA sample: its lines are evidence (twice, in two
    layouts), its first line the question, its language and source the answer."""
    d = spread(table(spark, sf_dir, "documents"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return d.select(
        F.col("doc_id").alias("pos"), F.get(lines, F.lit(0)).alias("question"),
        F.when(F.col("doc_id") % 2 == 1, F.format_string("q%d", "doc_id")).alias("question_id"), F.lit("").alias("qid"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("id"),
        F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("value"), F.col("source").alias("text"),
                 F.array("source", F.lit(" "), F.when(F.col("doc_id") % 4 == 0, F.col("lang"))).alias("aliases")).alias("answer"),
        F.struct(F.transform(lines, lambda x: F.struct(F.col("source").alias("title"), x.alias("text"))).alias("wikipedia")).alias("evidence"),
        F.struct(F.array("source").alias("title"), lines.alias("description")).alias("search_results"), F.col("lang").alias("context"))


def sample_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_evidence(nested_samples(spark, sf_dir))


def sample_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = W.joined_aliases(select_questions(nested_samples(spark, sf_dir), None, variant="fallback_text"))
    return q.select("pos", "query_id", "question", "answer_value", "aliases", F.size("answer_aliases").cast("long").alias("num_aliases"))


def sample_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus_from_samples(nested_samples(spark, sf_dir)).chunks


def passage_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_passage_corpus(nested_samples(spark, sf_dir)).chunks.select("doc_pos", "text")


def rare_word_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 alone, for the longest word of each benchmark text: most match fewer
    than three chunks, so the rest is padded."""
    chunks = cut_lineage(documents_corpus(spread(table(spark, sf_dir, "documents"))).chunks)
    word = F.array_max(F.transform(bm25_tokens("text"), lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t"))))["t"]
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), word.alias("query"))
    index = build_bm25(chunks)
    terms = weighted_terms(index, queries)
    top = hybrid_top_k(score_terms(index, terms), None, queries.select("query_id"), chunks.select(F.col("chunk_id").alias("doc_id")), k=3,
                       bm25_weight=1.0, rescore=lambda pairs: score_terms(index, terms, only=pairs))
    return top.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), _r("score").alias("score"))


def turn_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", is_valid_query("text").alias("valid"), has_alnum("text").alias("routable"),
        truncate_text("text", TURN_CHARS).alias("snippet"))


def two_gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against two golds each: the turn before and the one before that."""
    from ..operators.scoring import evaluate_predictions
    conv = table(spark, sf_dir, "conversations")
    pairs = conversation_pairs(spark, sf_dir)
    older = conv.select(F.struct("conv_id", (F.col("turn") + 2).alias("turn")).alias("rid"), F.col("text").alias("older"))
    two = pairs.join(older, "rid").select("rid", "prediction", F.concat("golds", F.array("older")).alias("golds"))
    ev = evaluate_predictions(two, "rid", with_rouge=False)
    return ev.select("rid.conv_id", "rid.turn", "em", _r("f1").alias("f1"), "answer_contains_gold")


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing log written as CSV in the 12-column layout and read back."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}/log.csv"
    log = events_log(spark, sf_dir).withColumn("memory_id", F.when(F.col("source") == "memory", F.col("seq")))
    W.write_log_csv(log, path, LOG_V2_COLUMNS)
    back = read_log(spark, path)
    return back.groupBy("query", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("memory_id").alias("n_memory"), F.sum("memory_id").alias("sum_memory_id"),
        F.min("timestamp").alias("first_ts"), _r(F.sum("confidence")).alias("sum_confidence"), _r(F.sum("latency")).alias("sum_latency"), F.count("sim_docs").alias("n_sim_docs"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events_summary(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("string"))
    empty = {c: F.lit(None).cast("double") for c in ("avg_em", "avg_f1", "avg_rouge_l", "avg_bleu")}
    return s.withColumns(empty | {"dataset": F.lit("events"), "corpus_size": F.lit(None).cast("long"), "path": F.col("run_id")})


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.cross_run_table(_runs(spark, sf_dir))
    return t.select("run_id", "dataset", "num_questions", _r("avg_confidence").alias("avg_confidence"), _r("avg_latency_s").alias("avg_latency_s"),
                    _r("memory_path_rate").alias("memory_path_rate"), "final_memory_size")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut_lineage(_runs(spark, sf_dir))
    return W.master_report(s, best_run(s, "avg_confidence")).withColumn("run_id", F.coalesce("run_id", F.lit("all")))


REGISTRY = {f.__name__: f for f in (sample_evidence, sample_questions, sample_corpus, passage_corpus, rare_word_top3, turn_guards,
                                    two_gold_scores, log_round_trip, run_rollup, report_lines)}
