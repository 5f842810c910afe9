"""End-to-end runs on a small nested fixture."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkrecall.operators.generate import LLM_ERROR, generate_answers
from sparkrecall.operators.prompts import build_prompt
from sparkrecall.plans.evaluation import Profile, run_evaluation
from sparkrecall.plans.pipeline import build_index, process_queries

SCHEMA = ("pos long, question string, question_id string, "
          "answer struct<value:string, aliases:array<string>>, "
          "evidence struct<wikipedia:array<struct<text:string>>>")

FACTS = ["Paris is the capital and largest city of France.",
         "The Nile is the longest river flowing through north eastern Africa.",
         "Mount Everest is the highest mountain above sea level on Earth.",
         "The Pacific Ocean is the largest and deepest ocean basin on Earth."] + [
    f"Filler note number {i} describes an unrelated topic in plain words." for i in range(20)]
QS = [("What is the capital of France?", "Paris"), ("Which river flows through north eastern Africa?", "Nile"),
      ("WHAT IS THE CAPITAL OF FRANCE?", "Paris"), ("Highest mountain on Earth?", "Mount Everest"),
      ("?!", "nothing")]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, q, f"id{i}", (a, [a.lower()]), ([(f,) for f in FACTS],)) for i, (q, a) in enumerate(QS)]
    return spark.createDataFrame(rows, SCHEMA)


def test_run_evaluation_end_to_end(spark, samples, tmp_path):
    res = run_evaluation(spark, samples, Profile("tiny", 5, 10, 100), str(tmp_path), threshold=0.9)
    p = {r["query_id"]: r for r in res.predictions.collect()}
    # the repeated question (same token bag) is served from memory with the stored answer
    assert p["id2"]["source"] == "memory" and p["id2"]["memory_id"] == 0
    assert p["id2"]["generated_answer"] == p["id0"]["generated_answer"]
    assert p["id0"]["generated_answer"].startswith("Paris")
    assert p["id0"]["em"] == 0.0 and p["id0"]["answer_contains_gold"]
    s = res.summary.collect()[0]
    # '?!' has no letter or digit: rejected by the guard, not routed
    assert s["memory_path_count"] == 1 and s["final_memory_size"] == 3 and s["num_questions"] == 4
    assert res.memory.count() == 3 and res.rejected.count() == 1
    [run] = [d for d in os.listdir(tmp_path) if d.startswith("tiny_")]
    for name in ("planned_queries", "predictions.csv", "predictions.jsonl", "log", "memory"):
        assert os.path.isdir(f"{tmp_path}/{run}/{name}")
    for name in ("summary_metrics.json", "summary_metrics.csv", "run_config.json", "corpus_info.json", "report.json"):
        assert os.path.isfile(f"{tmp_path}/{run}/{name}")  # small artifacts are plain files


def test_generation_errors_are_values(spark):
    def boom(prompt):
        raise RuntimeError("model failed to load")
    df = spark.createDataFrame([("q", ["doc"])], "q string, docs array<string>").withColumn(
        "prompt", build_prompt("q", "docs"))
    a = generate_answers(df, "prompt", boom).collect()[0]["answer"]
    assert a.startswith(LLM_ERROR) and "model failed to load" in a


def test_hit_on_empty_answer_regenerates_without_storing(spark):
    chunks = spark.createDataFrame([(i, f) for i, f in enumerate(FACTS)], "chunk_id long, text string")
    index = build_index(chunks)
    q = spark.createDataFrame([(0, "a", "capital of France"), (1, "b", "capital of France")],
                              "seq long, query_id string, question string")
    res = process_queries(q, index, threshold=0.9, generate=lambda p: "", golds=None)
    p = {r["query_id"]: r for r in res.predictions.collect()}
    assert p["b"]["source"] == "memory" and p["b"]["generated_answer"] == ""
    assert res.memory.count() == 1
    # a later run meets the empty answer, generates one for its row, and stores nothing
    later = process_queries(q, index, threshold=0.9, memory=res.memory, generate=lambda p: "made anew", golds=None)
    assert {r["generated_answer"] for r in later.predictions.collect()} == {"made anew"}
    assert later.new_memory.count() == 0 and later.memory.collect()[0]["answer"] == ""


def test_prompt_budget(spark):
    long = "x" * 900
    df = spark.createDataFrame([(["", long, "second doc", "third"], "Q?")], "docs array<string>, q string")
    prompt = df.select(build_prompt("q", "docs").alias("p")).collect()[0]["p"]
    ctx = prompt.split("Context:\n")[1].split("\n\nQuestion:")[0]
    assert ctx == "x" * 797 + "..."   # first non-empty snippet truncated; 2nd doc slot was the empty one
    df2 = spark.createDataFrame([(["a" * 700, "b" * 701], "Q")], "docs array<string>, q string")
    ctx2 = df2.select(build_prompt("q", "docs").alias("p")).collect()[0]["p"].split("Context:\n")[1]
    assert ctx2.startswith("a" * 700 + "\n\nQuestion") or ctx2.split("\n\nQuestion")[0] == "a" * 700


def test_memory_persists_across_runs(spark):
    chunks = spark.createDataFrame([(i, f) for i, f in enumerate(FACTS)], "chunk_id long, text string")
    index = build_index(chunks)
    first = spark.createDataFrame([(0, "a", "capital of France"), (1, "b", "longest river in Africa")],
                                  "seq long, query_id string, question string")
    r1 = process_queries(first, index, threshold=0.9, golds=None, run_id="run1")
    mem = r1.memory
    assert mem.count() == 2
    second = spark.createDataFrame([(0, "c", "Capital of france"), (1, "d", "tallest mountain")],
                                   "seq long, query_id string, question string")
    r2 = process_queries(second, index, threshold=0.9, memory=mem, golds=None, run_id="run2")
    p = {r["query_id"]: r for r in r2.predictions.collect()}
    first_answers = {r["id"]: r["answer"] for r in mem.collect()}
    assert p["c"]["source"] == "memory" and p["c"]["memory_id"] == 0
    assert p["c"]["generated_answer"] == first_answers[0]
    assert p["d"]["source"] == "retrieval" and p["d"]["memory_size"] == 3   # 2 preloaded + 1 stored
    assert sorted(r["id"] for r in r2.memory.collect()) == [0, 1, 2]


def test_preloaded_ids_with_a_gap(spark):
    chunks = spark.createDataFrame([(i, f) for i, f in enumerate(FACTS)], "chunk_id long, text string")
    index = build_index(chunks)
    first = spark.createDataFrame([(0, "a", "capital of France"), (1, "b", "longest river in Africa"), (2, "c", "highest mountain above sea")],
                                  "seq long, query_id string, question string")
    memory = process_queries(first, index, threshold=0.9, golds=None).memory.filter("id != 1")
    new = process_queries(spark.createDataFrame([(0, "d", "deepest ocean basin")], "seq long, query_id string, question string"),
                          index, threshold=0.9, memory=memory, golds=None)
    assert sorted(r["id"] for r in new.memory.collect()) == [0, 2, 3]
    assert [r["id"] for r in new.new_memory.collect()] == [3]


def test_correct_answer_is_the_value(spark):
    index = build_index(spark.createDataFrame([(i, f) for i, f in enumerate(FACTS)], "chunk_id long, text string"))
    q = spark.createDataFrame([(0, "a", "capital of France", "Paris", ["City of Light", "Paris"]), (1, "b", "longest river", "Nile", [])],
                              "seq long, query_id string, question string, answer_value string, answer_aliases array<string>")
    p = {r["query_id"]: r for r in process_queries(q, index, threshold=0.9).predictions.collect()}
    assert p["a"]["correct_answer"] == "Paris" and p["b"]["correct_answer"] == "Nile" and p["b"]["em"] == 0.0


def test_error_policies(spark, samples, tmp_path):
    def _failing(prompt):
        raise RuntimeError("backend is down")
    with pytest.raises(Exception, match="LLM backend error"):
        run_evaluation(spark, samples, Profile("tiny", 5, 10, 100), str(tmp_path), generate=_failing)
    res = run_evaluation(spark, samples, Profile("tiny", 5, 10, 100), str(tmp_path), generate=_failing, on_error="capture", threshold=0.9)
    rows = res.predictions.collect()
    assert rows and all(r["em"] is None and "backend is down" in r["error"] for r in rows)
    assert res.summary.count() == 0  # no valid row
    assert {r["answer"] for r in res.new_memory.collect()} == {""}


def test_suite_ends_with_a_roll_up(spark, samples, tmp_path):
    from sparkrecall.plans.evaluation import run_suite
    from sparkrecall.plans.reports import aggregate_runs
    from sparkrecall.sources import readers as R
    out = str(tmp_path)
    profiles = (Profile("one", 3, 10, 100), Profile("two", 5, 10, 100))
    first = run_suite(spark, samples, out, profiles, threshold=0.9, labels={"dataset": "tiny", "model": "first sentence"})
    summaries = R.read_summaries(spark, out)
    assert summaries.count() == 2 and aggregate_runs(spark, out).runs.count() == 2
    got = {r["run_id"].split("_")[0]: r for r in summaries.collect()}
    assert got["one"]["dataset"] == "tiny" and got["one"]["model"] == "first sentence" and got["two"]["num_questions"] == 4
    assert got["two"]["memory_path"]["count"] == 1 and got["two"]["log_file"].endswith("/log")
    preds = R.read_predictions_csv(spark, out)
    assert preds.count() == first["one"].predictions.count() + first["two"].predictions.count()
    assert {r["run_name"] for r in preds.select("run_name").collect()} == {r["run_id"] for r in got.values()}
    assert dict(preds.dtypes)["f1"] == "double"
    config = json.loads(spark.read.text(f"{out}/{got['one']['run_id']}/run_config.json").first()[0])
    assert config["num_questions"] == 3 and config["dataset"] == "tiny" and config["log_file"] == got["one"]["log_file"]
    for name in ("all_runs.csv", "all_runs.json", "combined.csv", "report.json"):
        assert os.path.isdir(f"{out}/roll_up/{name}")
    table = spark.read.option("header", True).csv(f"{out}/roll_up/all_runs.csv")
    assert table.count() == 2 and len(table.columns) == 14
    report = spark.read.json(f"{out}/roll_up/report.json").collect()
    assert [r["value"] for r in report if r["label"] == "Total runs"] == ["2"]
    run_suite(spark, samples, out, profiles, threshold=0.9)
    assert R.read_summaries(spark, out).count() == 4 and R.read_predictions_csv(spark, out).count() == 2 * preds.count()


def test_a_run_written_again_leaves_no_duplicates(spark, samples, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        run_evaluation(spark, samples, Profile("tiny", 5, 10, 100), out, threshold=0.9, run_id="fixed")
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/fixed/memory").collect()) == [0, 1, 2]
    assert spark.read.parquet(f"{out}/fixed/log").count() == 4
