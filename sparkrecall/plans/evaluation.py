"""A whole evaluation run as one composed job, and a suite of runs.

run_evaluation: samples -> corpus (evidence, fallback, chunks) -> evaluation
questions -> batch routing/retrieval/generation -> scores -> summary, notes ->
sinks (manifest, predictions, summary, config, corpus info, log, memory)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Provider
from ..operators.generate import Generator, extractive_generator
from ..operators.routing import THRESHOLD
from ..operators.samples import select_questions
from ..operators.telemetry import interpretation_notes, run_summary, summary_stamp
from ..sources import writers as W
from ..sources.one_file import write_json_file
from .corpus import build_corpus_from_samples
from .pipeline import RunResult, build_index, process_queries
from .reports import write_roll_up

# What a run is labelled by in its summary and configuration.
RUN_LABELS = ("dataset", "split", "mode", "memory_mode", "model", "embedding_model")


@dataclass
class Profile:
    name: str
    num_questions: int
    corpus_pool_size: int
    max_chunks: int


# The two default profiles.
DEFAULT_PROFILES = (Profile("smoke", 5, 140, 500), Profile("pilot", 8, 260, 900))


def unique_run_id(profile: str) -> str:
    """``{profile}_{yyyymmdd_hhmmss}`` and a random part, so no two runs share a folder."""
    return f"{profile}_{datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"


def run_evaluation(spark: SparkSession, samples, profile: Profile, out_dir: str, *,
                   threshold: float = THRESHOLD, generate: Generator = extractive_generator,
                   provider: Provider | None = None, run_id: str | None = None, memory: DataFrame | None = None,
                   on_error: str = "raise", labels: dict | None = None) -> RunResult:
    """``samples``: nested QA rows with a ``pos`` column (see sources.readers.read_samples).
    ``memory``: entries of earlier runs. ``on_error``: 'raise' stops a run at the first
    generation error, 'capture' keeps the row with its error and without metrics.
    ``labels``: dataset, split, mode, memory_mode, model, embedding_model of the run."""
    pool = samples.filter(F.col("pos") < profile.corpus_pool_size)
    corpus = build_corpus_from_samples(pool, max_docs=profile.corpus_pool_size, max_chunks=profile.max_chunks, write=True)
    questions = select_questions(pool, profile.num_questions).withColumnRenamed("pos", "seq")
    rid = run_id or unique_run_id(profile.name)
    labels = {k: (labels or {}).get(k) for k in RUN_LABELS}
    index = build_index(corpus.chunks, provider)
    res = process_queries(questions, index, threshold=threshold, generate=generate, provider=provider,
                          run_id=rid, memory=memory, on_error=on_error)
    counts = corpus.stats.first()
    summary = interpretation_notes(run_summary(res.predictions, valid_only=on_error == "capture")).withColumn("timestamp", summary_stamp()) \
        .withColumn("threshold", F.lit(threshold)) \
        .withColumn("corpus_size", F.lit(counts["chunk_count"])) \
        .withColumn("documents_before_chunking", F.lit(counts["documents_before_chunking"])) \
        .withColumns({k: F.lit(v).cast("string") for k, v in labels.items()})
    base = out_dir.rstrip("/") + "/" + rid
    W.write_manifest(questions, f"{base}/planned_queries")
    files = {"memory_file": f"{base}/memory", "index_file": f"{base}/memory", "log_file": f"{base}/log"}
    W.write_predictions(res.predictions, f"{base}/predictions.jsonl", f"{base}/predictions.csv")
    W.write_summary(summary.drop("notes").withColumns({k: F.lit(v) for k, v in files.items()}),
                    f"{base}/summary_metrics.json", f"{base}/summary_metrics.csv")
    W.write_run_config(spark, {"run_id": rid, "num_questions": profile.num_questions,
                               "corpus_pool_size": profile.corpus_pool_size, "max_chunks": profile.max_chunks,
                               "threshold": threshold, **labels, **files}, f"{base}/run_config.json")
    write_json_file(W.corpus_info(corpus.chunks, corpus.stats), f"{base}/corpus_info.json")
    W.append_log(res.log, f"{base}/log")
    W.append_memory(res.new_memory, f"{base}/memory", rid)
    write_json_file(W.run_report(summary), f"{base}/report.json")
    return replace(res, summary=summary)


def run_suite(spark: SparkSession, samples, out_dir: str, profiles=DEFAULT_PROFILES, **kw) -> dict:
    """One isolated run per profile (a short, fixed list of parameter sets), then the
    roll-up over all runs in ``out_dir``."""
    runs = {p.name: run_evaluation(spark, samples, p, out_dir, **kw) for p in profiles}
    write_roll_up(spark, out_dir)
    return runs
