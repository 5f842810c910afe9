"""Routing telemetry: running counters, per-query-text log metrics, per-run
summaries with per-path breakdown, interpretation notes, best run.

Log schema (one row per routed query): seq (arrival order), run_id, timestamp,
query, confidence, memory_id, sim_query, sim_answer, sim_docs, source, latency,
memory_size, retrieval_count, memory_count. Optional quality columns on
prediction tables: em, f1, rouge_l, bleu, answer_contains_gold, latency_s."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .ordering import running_sums

# Source labels and the interpretation-note rules.
MEMORY = "memory"
RETRIEVAL = "retrieval"
NOTE_RARE_MEMORY = ("Memory path triggered rarely; corpus diversity or threshold may be "
                    "limiting early memory reuse.")
NOTE_LOW_QUALITY = "Answer quality is currently low; retrieval context quality and prompting need improvement."
NOTE_HIGH_LATENCY = "Latency is high; consider smaller prompt context or generation limits."
NOTE_STABLE = "Run is stable with balanced routing and measurable answer quality."
RARE_MEMORY_RATE = 0.1
LOW_F1 = 0.1
HIGH_LATENCY_S = 20.0


def safe_double(c) -> Column:
    """'' / null / unparsable -> null (never an error)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string").try_cast("double")


def with_counters(log: DataFrame, run_col: str = "run_id", order_cols: tuple[str, ...] = ("seq",),
                  initial_memory_size: int = 0) -> DataFrame:
    """retrieval_count / memory_count: running counts of each path per run;
    memory_size: initial size + misses stored so far (inclusive)."""
    out = running_sums(log, [run_col], list(order_cols), {
        "retrieval_count": (F.col("source") == RETRIEVAL).cast("long"),
        "memory_count": (F.col("source") == MEMORY).cast("long"),
    })
    return out.withColumn("memory_size", F.col("retrieval_count") + F.lit(initial_memory_size))


def query_metrics(log: DataFrame, needle: str, order_col: str = "seq") -> DataFrame:
    """Metrics of every log row whose trimmed, lower-cased query contains the
    trimmed, lower-cased needle (blank rows skipped; blank needle -> no row).
    One row: matches, avg/max confidence, avg/min latency (nulls ignored),
    counts per source (memory/retrieval/other) and the latest matching row."""
    nd = (needle or "").strip().lower()
    q = F.lower(py_strip("query"))
    m = log.filter((q != "") & q.contains(F.lit(nd)) & F.lit(nd != ""))
    conf, lat = safe_double(F.col("confidence")), safe_double(F.col("latency"))
    src = F.lower(py_strip("source"))
    latest = F.max_by(F.struct("timestamp", "source", conf.alias("confidence"), lat.alias("latency"),
                               "memory_size", "retrieval_count", "memory_count"), F.col(order_col))
    agg = m.agg(F.lit(needle).alias("query"), F.count(F.lit(1)).alias("matches"),
                F.avg(conf).alias("avg_confidence"), F.max(conf).alias("max_confidence"),
                F.avg(lat).alias("avg_latency"), F.min(lat).alias("min_latency"),
                F.count_if(src == MEMORY).alias("memory"), F.count_if(src == RETRIEVAL).alias("retrieval"),
                F.count_if(~src.isin(MEMORY, RETRIEVAL)).alias("other"), latest.alias("latest"))
    return agg.filter(F.col("matches") > 0).select(
        "query", "matches", "avg_confidence", "max_confidence", "avg_latency", "min_latency",
        "memory", "retrieval", "other",
        F.col("latest.timestamp").alias("latest_timestamp"), F.col("latest.source").alias("latest_source"),
        F.col("latest.confidence").alias("latest_confidence"), F.col("latest.latency").alias("latest_latency"),
        F.col("latest.memory_size").alias("latest_memory_size"),
        F.col("latest.retrieval_count").alias("latest_retrieval_count"),
        F.col("latest.memory_count").alias("latest_memory_count"))


def _avg0(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def run_summary(preds: DataFrame, run_col: str = "run_id", order_col: str = "seq",
                latency_col: str = "latency_s", valid_only: bool = False, final_memory_size: bool = False) -> DataFrame:
    """One row per run: means (0.0 when empty) of the quality columns present,
    confidence and latency; path counts and rates over all rows; hallucination
    rate (share not containing gold); per-path count/avg em/f1/confidence with
    0.0 for an empty path; final memory size = memory_size of the last row (with
    ``final_memory_size``, for logs without counters: the number of misses).
    A single aggregation with conditional aggregates (partial aggregation map-side)."""
    if valid_only and "em" in preds.columns:
        preds = preds.filter(F.col("em").isNotNull())
    cols = set(preds.columns)
    n = F.count(F.lit(1))
    is_mem, is_ret = F.col("source") == MEMORY, F.col("source") == RETRIEVAL
    aggs = [n.alias("num_questions")]
    for m in ("em", "f1", "rouge_l", "bleu"):
        if m in cols:
            aggs.append(_avg0(F.col(m)).alias(f"avg_{m}"))
    aggs += [_avg0(F.col("confidence")).alias("avg_confidence"),
             _avg0(F.col(latency_col)).alias("avg_latency_s"),
             F.count_if(is_mem).alias("memory_path_count"), F.count_if(is_ret).alias("retrieval_path_count")]
    if "answer_contains_gold" in cols:
        aggs.append(F.count_if(~F.col("answer_contains_gold")).alias("_halluc"))
    for path, cond in ((MEMORY, is_mem), (RETRIEVAL, is_ret)):
        for m in ("em", "f1", "confidence"):
            if m in cols:
                aggs.append(_avg0(F.when(cond, F.col(m))).alias(f"{path}_path_avg_{m}"))
    if "memory_size" in cols:
        aggs.append(F.max_by("memory_size", order_col).alias("final_memory_size"))
    elif final_memory_size:
        aggs.append(F.count_if(is_ret).alias("final_memory_size"))
    s = preds.groupBy(run_col).agg(*aggs)
    tot = F.col("num_questions")
    s = (s.withColumn("memory_path_rate", F.col("memory_path_count") / tot)
         .withColumn("retrieval_path_rate", F.col("retrieval_path_count") / tot)
         .withColumn("retrieval_call_rate", F.col("retrieval_path_count") / tot))
    if "_halluc" in s.columns:
        s = s.withColumn("hallucination_rate", F.col("_halluc") / tot).drop("_halluc")
    return s


def phase_summary(preds: DataFrame, phase: str, smoke_size: int | None = None, run_col: str = "run_id", **kw) -> DataFrame:
    """``run_summary`` over the valid rows of predictions whose errors were captured,
    with total_queries and error_count over all rows, and the run's phase and smoke_size.
    A run without a valid row has zeros."""
    totals = preds.groupBy(run_col).agg(F.count(F.lit(1)).alias("total_queries"), F.count("error").alias("error_count"))
    valid = run_summary(preds, run_col=run_col, valid_only=True, **kw)
    return (totals.join(valid, run_col, "left").fillna(0)
            .withColumns({"phase": F.lit(phase), "smoke_size": F.lit(smoke_size).cast("long")}))


def interpretation_notes(summary: DataFrame) -> DataFrame:
    """Adds ``notes`` (array<string>) by the fixed rules; 'stable' when none fire."""
    f1 = F.coalesce(F.col("avg_f1"), F.lit(0.0)) if "avg_f1" in summary.columns else F.lit(0.0)
    notes = F.filter(F.array(
        F.when(F.col("memory_path_rate") < RARE_MEMORY_RATE, F.lit(NOTE_RARE_MEMORY)),
        F.when(f1 < LOW_F1, F.lit(NOTE_LOW_QUALITY)),
        F.when(F.col("avg_latency_s") > HIGH_LATENCY_S, F.lit(NOTE_HIGH_LATENCY))), lambda x: x.isNotNull())
    return summary.withColumn("notes", F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(NOTE_STABLE))))


def best_run(summaries: DataFrame, metric: str = "avg_f1", order_col: str = "run_id") -> DataFrame:
    """The run with the highest metric (missing = 0.0); the first by
    ``order_col`` wins ties. A top-1 report: one TakeOrderedAndProject."""
    return summaries.orderBy(F.desc(F.coalesce(F.col(metric), F.lit(0.0))), F.col(order_col)).limit(1)


def fmt3(c) -> Column:
    """3 decimals, or 'NA' for null; a tie goes to the even digit."""
    col = F.col(c) if isinstance(c, str) else c
    # format_string renders a null argument as text, so test for null first
    return F.when(col.isNull(), F.lit("NA")).otherwise(F.format_string("%.3f", F.bround(col.cast("double"), 3)))


def fmt_pct(c) -> Column:
    """Percent with one decimal (a tie goes to the even digit); null counts as 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.1f%%", F.bround(F.coalesce(col.cast("double"), F.lit(0.0)) * 100, 1))


# Fixed formats of run ids and summary stamps.
RUN_ID_TS = "yyyyMMdd_HHmmss"
SUMMARY_TS = "yyyy-MM-dd_HH-mm-ss"


def run_id(profile: str, ts=None) -> Column:
    """``{profile}_{yyyyMMdd_HHmmss}`` of ``ts`` (default: now)."""
    t = F.current_timestamp() if ts is None else (F.col(ts) if isinstance(ts, str) else ts)
    return F.concat_ws("_", F.lit(profile), F.date_format(t, RUN_ID_TS))


def summary_stamp(ts=None) -> Column:
    t = F.current_timestamp() if ts is None else (F.col(ts) if isinstance(ts, str) else ts)
    return F.date_format(t, SUMMARY_TS)
