"""Sinks of a run: manifests, predictions, summaries, config, corpus info,
telemetry and memory appends, cross-run tables and report lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.memory import TS_FORMAT
from ..operators.ordering import ordered_cap
from ..operators.telemetry import fmt_pct
from .one_file import write_csv_file, write_json_file, write_lines

# Fixed column orders of the reference's files.
PREDICTION_COLUMNS = ["query_id", "question", "generated_answer", "correct_answer", "confidence", "source", "em",
                      "f1", "rouge_l", "bleu", "answer_contains_gold", "latency_s", "memory_size",
                      "retrieval_count", "memory_count"]
CROSS_RUN_COLUMNS = ["run_id", "timestamp", "dataset", "num_questions", "corpus_size", "avg_em", "avg_f1",
                     "avg_rouge_l", "avg_bleu", "avg_confidence", "avg_latency_s", "memory_path_rate",
                     "retrieval_path_rate", "final_memory_size"]
FLAT_SUMMARY_COLUMNS = ["run_id", "timestamp", "dataset", "split", "num_questions", "corpus_size", "model",
                        "embedding_model", "threshold", "avg_em", "avg_f1", "avg_rouge_l", "avg_bleu",
                        "avg_confidence", "avg_latency_s", "hallucination_rate", "memory_path_count",
                        "memory_path_rate", "retrieval_path_count", "retrieval_path_rate", "memory_path_avg_em",
                        "memory_path_avg_f1", "memory_path_avg_confidence", "retrieval_path_avg_em",
                        "retrieval_path_avg_f1", "retrieval_path_avg_confidence", "final_memory_size"]
# Characters kept of each chunk in the corpus info.
CORPUS_INFO_CHARS = 240
CORPUS_INFO_CHUNKS = 10


def _csv(df: DataFrame, path: str, mode: str = "overwrite"):
    (df.write.mode(mode).option("header", True).option("escape", '"').option("timestampFormat", TS_FORMAT)
     .option("timestampNTZFormat", TS_FORMAT).csv(path))


def manifest(questions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """query_id, question, answer_value, num_aliases (+ extra columns)."""
    return questions.select("query_id", "question", "answer_value",
                            F.size("answer_aliases").alias("num_aliases"), *extra)


def joined_aliases(preds: DataFrame, aliases: str = "answer_aliases", out: str = "aliases") -> DataFrame:
    """The alias list as one string (the phase-2 predictions layout)."""
    return preds.withColumn(out, F.array_join(aliases, " | "))


def smoke_manifest(queries: DataFrame) -> DataFrame:
    """query_id, question, answer_value, num_aliases, num_evidence (smoke runner)."""
    return queries.select("query_id", "question", "answer_value", F.size("answer_aliases").alias("num_aliases"),
                          F.coalesce(F.size("evidence.wikipedia"), F.lit(0)).alias("num_evidence"))


def answer_manifest(queries: DataFrame) -> DataFrame:
    """query_id, question, correct_answer (fast synthetic runner)."""
    return queries.select("query_id", "question", F.col("answer").alias("correct_answer"))


def write_manifest(questions: DataFrame, path: str):
    _csv(manifest(questions), path)


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fixed column order; missing columns -> null, extra columns dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])


def write_predictions(preds: DataFrame, path_jsonl: str, path_csv: str, escaped: bool = False):
    """JSON lines and CSV. ``escaped``: characters beyond ASCII as ``\\u`` escapes in the JSON."""
    preds.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", escaped).json(path_jsonl)
    _csv(select_columns(preds, PREDICTION_COLUMNS), path_csv)


def nest_summary(flat: DataFrame) -> DataFrame:
    """Flat summary -> nested form with memory_path / retrieval_path structs."""
    def path(p):
        return F.struct(F.col(f"{p}_path_count").alias("count"),
                        *[F.col(f"{p}_path_avg_{m}").alias(f"avg_{m}") for m in ("em", "f1", "confidence")
                          if f"{p}_path_avg_{m}" in flat.columns])
    return flat.withColumn("memory_path", path("memory")).withColumn("retrieval_path", path("retrieval"))


def flatten_summary(nested: DataFrame) -> DataFrame:
    cols = []
    for c in FLAT_SUMMARY_COLUMNS:
        if c in nested.columns:
            cols.append(F.col(c))
        elif c.startswith(("memory_path_avg_", "retrieval_path_avg_")):
            p, m = c.split("_path_avg_")
            known = f"{p}_path" in nested.columns and f"avg_{m}" in nested.schema[f"{p}_path"].dataType.fieldNames()
            cols.append((F.col(f"{p}_path.avg_{m}") if known else F.lit(None).cast("double")).alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return nested.select(*cols)


def write_summary(summary: DataFrame, path_json: str, path_csv: str):
    """A run's summary as one JSON file (nested) and one CSV file (flat)."""
    nested = nest_summary(summary) if "memory_path" not in summary.columns else summary
    write_json_file(nested, path_json)
    write_csv_file(flatten_summary(nested), path_csv, {"escape": '"', "timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT})


def write_run_config(spark, config: dict, path: str):
    """One JSON object with the run's parameters."""
    write_lines(spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1), path)


def corpus_info(chunks: DataFrame, stats: DataFrame, chars: int = CORPUS_INFO_CHARS,
                n: int = CORPUS_INFO_CHUNKS) -> DataFrame:
    """Counts plus the first chunks cut to ``chars`` characters (a top-n report)."""
    first = ordered_cap(chunks, n, ["chunk_id"]).select("chunk_id", F.substring("text", 1, chars).alias("text"))
    return first.select("chunk_id", "text", *[stats.select(c).scalar().alias(c) for c in stats.columns])


def _write_run(df: DataFrame, path: str, run_col: str):
    """Adds a run's rows to a table partitioned by run; a run written again replaces
    its own rows, so a repeated write leaves no duplicates."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def append_log(log: DataFrame, path: str, run_col: str = "run_id"):
    """Append a run's log rows (blank queries dropped), partitioned by run."""
    _write_run(log.filter(F.trim(F.coalesce(F.col("query"), F.lit(""))) != ""), path, run_col)


def write_log_csv(log: DataFrame, path: str, columns: list[str]):
    """Log rows as CSV with a header, in the given column layout."""
    _csv(select_columns(log, columns), path)


def append_memory(entries: DataFrame, path: str, run_id: str = "run"):
    """Memory store, partitioned by run: only the new entries are written."""
    _write_run(entries.withColumn("run_id", F.lit(run_id)), path, "run_id")


def cross_run_table(summaries: DataFrame) -> DataFrame:
    """One row per run, the fixed 14 columns (missing -> null), path order."""
    s = summaries if "path" in summaries.columns else summaries.withColumn("path", F.col("run_id"))
    return select_columns(s.orderBy("path"), CROSS_RUN_COLUMNS)


def write_cross_run(summaries: DataFrame, path_csv: str, path_json: str):
    """The cross-run table as CSV and all summaries as JSON lines, in path order."""
    _csv(cross_run_table(summaries), path_csv)
    summaries.orderBy("path").drop("path").write.mode("overwrite").json(path_json)


def write_combined_predictions(preds: DataFrame, path: str):
    """All runs' predictions with their run_name as one CSV table."""
    _csv(preds, path)


# The labels of the reports.
REPORT_LABELS = ("Dataset", "Questions", "Corpus", "EM/F1", "ROUGE-L/BLEU", "Memory/Retrieval", "Avg latency")
TOTAL_RUNS, BEST_RUN, INTERPRETATION = "Total runs", "Best run by F1", "Interpretation"


def master_report(summaries: DataFrame, best: DataFrame) -> DataFrame:
    """``report_lines`` of all runs, with the total and the best run ahead (run_id null)."""
    total = summaries.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(None).cast("string").alias("run_id"), F.lit(0).alias("line_no"), F.lit(TOTAL_RUNS).alias("label"), "value")
    top = best.select(F.lit(None).cast("string").alias("run_id"), F.lit(1).alias("line_no"), F.lit(BEST_RUN).alias("label"),
                      F.col("run_id").alias("value"))
    return total.unionByName(top).unionByName(report_lines(summaries))


def run_report(summary: DataFrame) -> DataFrame:
    """One run's report: its metric lines, then its interpretation notes."""
    lines = report_lines(summary)
    notes = summary.select("run_id", F.posexplode("notes").alias("i", "value")).select(
        "run_id", (F.col("i") + len(REPORT_LABELS)).alias("line_no"), F.lit(INTERPRETATION).alias("label"), "value")
    return lines.unionByName(notes)


def report_lines(summaries: DataFrame) -> DataFrame:
    """The lines of every run as a tall table (run_id, line_no, label, value)."""
    def f4(c):
        return F.format_string("%.4f", F.bround(F.coalesce(F.col(c), F.lit(0.0)), 4))
    values = [
        F.coalesce(F.col("dataset").cast("string"), F.lit("None")),
        F.coalesce(F.col("num_questions").cast("string"), F.lit("None")),
        F.coalesce(F.col("corpus_size").cast("string"), F.lit("None")),
        F.concat(f4("avg_em"), F.lit(" / "), f4("avg_f1")),
        F.concat(f4("avg_rouge_l"), F.lit(" / "), f4("avg_bleu")),
        F.concat(fmt_pct("memory_path_rate"), F.lit(" / "), fmt_pct("retrieval_path_rate")),
        F.concat(F.format_string("%.3f", F.bround(F.coalesce(F.col("avg_latency_s"), F.lit(0.0)), 3)), F.lit("s")),
    ]
    items = list(zip(REPORT_LABELS, values, strict=True))
    arr = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(lbl).alias("label"), v.cast("string").alias("value"))
                    for i, (lbl, v) in enumerate(items)])
    return summaries.select("run_id", F.explode(arr).alias("x")).select("run_id", "x.*")
