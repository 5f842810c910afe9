import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkrecall.plans.reports import aggregate_runs
from sparkrecall.sources import readers as R
from sparkrecall.sources import writers as W


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def _summary(run, f1, mem_rate=0.5):
    return {"run_id": run, "timestamp": "2026-01-01_00-00-00", "dataset": "d", "num_questions": 4,
            "corpus_size": 10, "avg_em": 0.0, "avg_f1": f1, "avg_rouge_l": 0.1, "avg_bleu": 0.01,
            "avg_confidence": 0.5, "avg_latency_s": 1.0, "memory_path_rate": mem_rate,
            "retrieval_path_rate": 1 - mem_rate, "final_memory_size": 3,
            "memory_path": {"count": 2, "avg_em": 0.0, "avg_f1": f1, "avg_confidence": 0.7}}


def test_summaries_skip_broken_files_and_best_run_first_wins(spark, tmp):
    for run, f1 in (("a_run", 0.3), ("b_run", 0.3), ("c_run", 0.1)):
        os.makedirs(f"{tmp}/{run}/ts", exist_ok=True)
        with open(f"{tmp}/{run}/ts/summary_metrics.json", "w") as f:
            f.write(("\n" if run == "b_run" else "") + json.dumps(_summary(run, f1), indent=2))
    os.makedirs(f"{tmp}/broken/ts")
    with open(f"{tmp}/broken/ts/summary_metrics.json", "w") as f:
        f.write('{"run_id": "broken", "avg_f1": ')
    agg = aggregate_runs(spark, tmp)
    runs = sorted(r["run_id"] for r in agg.runs.collect())
    assert runs == ["a_run", "b_run", "c_run"]
    assert agg.best.collect()[0]["run_id"] == "a_run"
    lines = agg.report.filter(F.col("run_id") == "a_run").orderBy("line_no").collect()
    assert lines[3]["value"] == "0.0000 / 0.3000" and lines[5]["value"] == "50.0% / 50.0%"


def test_log_reader_both_layouts(spark, tmp):
    v2 = ("timestamp,query,confidence,memory_id,sim_query,sim_answer,sim_docs,source,latency,memory_size,"
          "retrieval_count,memory_count\n"
          '2026-04-15 10:00:00.123456,"what, is ""this""\nsecond line",0,,,,,retrieval,1.5,1,1,0\n'
          "2026-04-15 10:00:01.000000,\\,1.0000001,0,1.0000001,0.9,0.5,memory,0.2,1,1,1\n")
    v1 = ("timestamp,query,confidence,sim_query,sim_answer,sim_docs,source,latency,memory_size,retrieval_count\n"
          "2026-04-14 09:00:00,old query,0.65,0.65,,,retrieval,3.0,2,2\n")
    os.makedirs(f"{tmp}/v2"); os.makedirs(f"{tmp}/v1")
    open(f"{tmp}/v2/log.csv", "w").write(v2)
    open(f"{tmp}/v1/log.csv", "w").write(v1)
    a = R.read_log(spark, f"{tmp}/v2/log.csv").collect()
    assert a[0]["query"] == 'what, is "this"\nsecond line' and a[0]["memory_id"] is None
    assert a[0]["confidence"] == 0.0 and a[1]["query"] == "\\" and a[1]["confidence"] == 1.0000001
    b = R.read_log(spark, f"{tmp}/v1/log.csv").collect()
    assert b[0]["memory_id"] is None and b[0]["memory_count"] is None and b[0]["confidence"] == 0.65


def test_predictions_csv_multiline_with_run_names(spark, tmp):
    import csv
    rows = [{"query_id": "q1", "generated_answer": "line one\nline two, with comma", "f1": "0.2"},
            {"query_id": "q2", "generated_answer": "[LLM_ERROR] boom", "f1": "0.0"}]
    for run in ("pilot_1", "smoke_2"):
        os.makedirs(f"{tmp}/{run}")
        with open(f"{tmp}/{run}/predictions.csv", "w", newline="") as f:
            w = csv.DictWriter(f, fieldnames=["query_id", "generated_answer", "f1"])
            w.writeheader()
            w.writerows(rows)
    got = R.read_predictions_csv(spark, tmp).collect()
    assert len(got) == 4
    assert sorted({r["run_name"] for r in got}) == ["pilot_1", "smoke_2"]
    assert "line one\nline two, with comma" in {r["generated_answer"] for r in got}
    # the writer round-trips through the same reader shape
    preds = spark.createDataFrame([("q", "a\nb", 0.5)], "query_id string, generated_answer string, f1 double")
    W.write_predictions(preds, f"{tmp}/w/predictions.jsonl", f"{tmp}/w/csv")
    back = R.read_predictions_csv(spark, f"{tmp}/w/csv", "*.csv").collect()
    assert back[0]["generated_answer"] == "a\nb" and back[0]["em"] is None


def test_memory_reader_missing_and_json(spark, tmp):
    assert R.read_memory(spark, f"{tmp}/nope.json").count() == 0
    entries = [{"id": 0, "query": "q", "query_embedding": [1.0, 0.0], "retrieved_docs": ["d1", "d2"],
                "answer": "", "answer_embedding": None, "timestamp": "2026-01-01 00:00:00.000001"}]
    open(f"{tmp}/mem.json", "w").write(json.dumps(entries, indent=4))
    m = R.read_memory(spark, f"{tmp}/mem.json").collect()
    assert m[0]["retrieved_docs"] == ["d1", "d2"] and m[0]["answer_embedding"] is None


def test_inventory_and_positions(spark, tmp):
    for name, body in (("a.csv", "x\n1\n"), ("b.json", "{}"), ("c.txt", "t"), ("d.bin", "b")):
        open(f"{tmp}/{name}", "w").write(body)
    inv = {r["extension"]: r["files"] for r in R.result_inventory(spark, tmp).collect()}
    assert inv == {"csv": 1, "json": 1, "txt": 1}
    lines = [json.dumps({"question": f"q{i}"}) for i in range(7)]
    open(f"{tmp}/s.jsonl", "w").write("\n".join(lines))
    s = R.read_samples(spark, f"{tmp}/s.jsonl", n=3).orderBy("pos").collect()
    assert [r["question"] for r in s] == ["q0", "q1", "q2"] and [r["pos"] for r in s] == [0, 1, 2]


def test_synthetic_qa_and_manifests(spark):
    q = R.synthetic_qa(spark, [("Q one?", "a"), ("Q two?", "b"), ("Q three?", "c")], n=2).collect()
    assert [r["query_id"] for r in q] == ["synthetic_000", "synthetic_001"]
    m = W.answer_manifest(R.synthetic_qa(spark, [("Q?", "x")])).collect()[0]
    assert m["correct_answer"] == "x"
    df = spark.createDataFrame([("q1", "Q?", "v", ["v", "w"], ([("t",), ("u",)],))],
                               "query_id string, question string, answer_value string, answer_aliases array<string>,"
                               " evidence struct<wikipedia:array<struct<text:string>>>")
    r = W.smoke_manifest(df).collect()[0]
    assert (r["num_aliases"], r["num_evidence"]) == (2, 2)


def test_stream_log_sink_appends_nonblank(spark, tmp):
    from sparkrecall.streaming.telemetry import stream_log_sink
    rows = [(1, "run", " q1 ", 0.5), (2, "run", "  ", 0.1), (3, "run2", "q3", 0.9)]
    src = f"{tmp}/src"
    spark.createDataFrame(rows, "seq long, run_id string, query string, confidence double").write.parquet(src)
    stream = spark.readStream.schema("seq long, run_id string, query string, confidence double").parquet(src)
    stream_log_sink(stream, f"{tmp}/out", f"{tmp}/ckpt").awaitTermination()
    got = sorted(r["seq"] for r in spark.read.parquet(f"{tmp}/out").collect())
    assert got == [1, 3]


def test_file_positions_jvm_side(spark, tmp):
    lines = [json.dumps({"q": f"q{i}"}) for i in range(50)]
    open(f"{tmp}/b.jsonl", "w").write("\n".join(lines[25:]))
    open(f"{tmp}/a.jsonl", "w").write("\n".join(lines[:25]))
    got = [r["q"] for r in R.with_file_positions(spark.read.json(tmp)).orderBy("pos").collect()]
    assert got == [f"q{i}" for i in range(50)]
    spark.read.json(tmp).write.parquet(f"{tmp}/pq")
    pq = R.with_file_positions(spark.read.parquet(f"{tmp}/pq")).collect()
    assert sorted(r["pos"] for r in pq) == list(range(50))
    log = ("timestamp,query,confidence,memory_id,sim_query,sim_answer,sim_docs,source,latency,memory_size,"
           "retrieval_count,memory_count\n" + "".join(f"2026-04-15 10:00:0{i},q{i},0.1,,,,,retrieval,1,1,1,0\n"
                                                      for i in range(5)))
    os.makedirs(f"{tmp}/lg")
    open(f"{tmp}/lg/log.csv", "w").write(log)
    seqs = [(r["seq"], r["query"]) for r in R.read_log_with_order(spark, f"{tmp}/lg/log.csv").orderBy("seq").collect()]
    assert seqs == [(i, f"q{i}") for i in range(5)]


def test_one_file_artifacts(spark, tmp):
    from sparkrecall.sources import one_file as O
    df = spark.createDataFrame([(i, 'say "a", é\nb' if i % 2 else None) for i in range(40)], "id long, text string").repartitionByRange(5, "id")
    os.makedirs(f"{tmp}/t.json")  # an older folder of that name gives way
    O.write_json_file(df, f"{tmp}/t.json")
    O.write_csv_file(df, f"{tmp}/t.csv", {"escape": '"'})
    assert sorted(os.listdir(tmp)) == ["t.csv", "t.json"] and os.path.isfile(f"{tmp}/t.json")
    rows = [json.loads(x) for x in open(f"{tmp}/t.json")]
    assert [r["id"] for r in rows] == list(range(40)) and rows[1]["text"] == 'say "a", é\nb' and "text" not in rows[0]
    import csv
    with open(f"{tmp}/t.csv", newline="") as f:
        back = list(csv.DictReader(f))
    assert [int(r["id"]) for r in back] == list(range(40)) and back[1]["text"] == 'say "a", é\nb'
    O.write_json_file(df.limit(0), f"{tmp}/none.json")
    assert open(f"{tmp}/none.json").read() == ""


def test_failed_task_leaves_the_old_file(spark, tmp, monkeypatch):
    from sparkrecall.sources import one_file as O
    O.write_json_file(spark.range(3), f"{tmp}/x.json")
    before = open(f"{tmp}/x.json").read()
    bad = spark.range(40).repartition(4).selectExpr("if(id = 17, raise_error('no'), id) as id")
    with pytest.raises(Exception, match="no"):
        O.write_json_file(bad, f"{tmp}/x.json")
    assert open(f"{tmp}/x.json").read() == before and os.listdir(tmp) == ["x.json"]


def test_escaped_predictions(spark, tmp):
    preds = spark.createDataFrame([("q", "né 中")], "query_id string, generated_answer string").coalesce(1)
    for escaped in (True, False):
        W.write_predictions(preds, f"{tmp}/{escaped}.jsonl", f"{tmp}/{escaped}.csv", escaped=escaped)
        text = "".join(open(f"{tmp}/{escaped}.jsonl/{f}").read() for f in os.listdir(f"{tmp}/{escaped}.jsonl") if f.startswith("part-"))
        assert text.isascii() == escaped and json.loads(text)["generated_answer"] == "né 中"
