"""Error policies, valid-row summaries, notes and best run."""

import pytest
from pyspark.sql import functions as F

from sparkrecall.operators.generate import fail_on_errors
from sparkrecall.operators.scoring import capture_errors
from sparkrecall.operators.telemetry import best_run, interpretation_notes, run_summary, fmt3, fmt_pct


def _preds(spark):
    rows = [(1, "r", "q1", " [LLM_ERROR] boom", 0.9, "memory", 1.0, 1.0, True, 1.0, 1),
            (2, "r", "q2", "Paris", 0.2, "retrieval", 0.0, 0.5, True, 30.0, 2),
            (3, "r", "q3", "Nile", 0.3, "retrieval", 1.0, 1.0, False, 50.0, 3)]
    return spark.createDataFrame(rows, "seq long, run_id string, query_id string, generated_answer string, "
                                       "confidence double, source string, em double, f1 double, "
                                       "answer_contains_gold boolean, latency_s double, memory_size long")


def test_fail_fast_raises(spark):
    df = _preds(spark).withColumnRenamed("generated_answer", "answer")
    with pytest.raises(Exception, match="LLM backend error"):
        fail_on_errors(df).collect()


def test_capture_errors_and_valid_summary(spark):
    p = capture_errors(_preds(spark), limit=10)
    errs = {r["query_id"]: r["error"] for r in p.collect()}
    assert errs["q1"] == " [LLM_ERRO" and errs["q2"] is None
    s = run_summary(p, valid_only=True).collect()[0]
    assert s["num_questions"] == 2 and s["memory_path_count"] == 0 and s["avg_em"] == 0.5
    assert s["memory_path_avg_f1"] == 0.0 and s["retrieval_path_avg_f1"] == 0.75 and s["final_memory_size"] == 3
    assert s["hallucination_rate"] == 0.5


def test_notes_and_best_run(spark):
    s = interpretation_notes(run_summary(_preds(spark))).collect()[0]
    assert len(s["notes"]) == 1 and s["notes"][0].startswith("Latency is high")   # f1 0.83, memory rate 0.33
    runs = spark.createDataFrame([("b", 0.3), ("a", 0.3), ("c", None)], "run_id string, avg_f1 double")
    assert best_run(runs).collect()[0]["run_id"] == "a"
    f = spark.createDataFrame([(None, 0.12345), (0.5, None)], "x double, y double").select(
        fmt3("x").alias("a"), fmt_pct("y").alias("b")).collect()
    assert (f[0]["a"], f[0]["b"], f[1]["a"], f[1]["b"]) == ("NA", "12.3%", "0.500", "0.0%")
