"""Needle tables, untyped samples and projections against brute force; the new
registered queries against their SQL."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.operators import samples as S
from sparkrecall.operators.needles import query_metrics_table
from sparkrecall.operators.projections import projected_knn
from sparkrecall.operators.telemetry import query_metrics
from sparkrecall.operators.untyped import explode_untyped_evidence
from sparkrecall.plans import search_oracles, search_queries

SF0001 = "/root/testdata/sf0.001"


def test_needles_equal_one_needle_at_a_time(spark):
    rnd = random.Random(2)
    words = ["alpha", "alphabet", "be", "Beta", "x", "Ünder", "the cat", ""]
    rows = [(i, " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))) + " ", rnd.choice(["memory", " Retrieval", "other", None]),
             rnd.choice([0.5, 0.25, None]), float(i % 7)) for i in range(200)] + [(500, None, "memory", 1.0, 1.0)]
    log = spark.createDataFrame(rows, "seq long, query string, source string, confidence double, latency double").withColumns(
        {"timestamp": F.lit("t"), "memory_size": F.col("seq"), "retrieval_count": F.lit(1), "memory_count": F.lit(2)})
    needles = [" ALPHA ", "alpha", "be", "x", "e c", "ünd", "", "  ", None, "zzz", "alphabet be", "a", "x x"]
    table = spark.createDataFrame([(n,) for n in needles + ["x"]], "needle string")
    got = {r["query"]: r.asDict() for r in query_metrics_table(log, table).collect()}
    want = {}
    for n in needles:
        for r in query_metrics(log, n or "").collect():
            want[n] = r.asDict()
    assert set(got) == set(want) and " ALPHA " in got
    for n, w in want.items():
        assert all(got[n][k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in w.items()), n


def walk(value):
    """The recursive walk, plainly."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [t for x in value for t in walk(x)]
    if isinstance(value, dict):
        out = [t for k in S.PREFERRED_KEYS if k in value for t in walk(value[k])]
        return out + [t for v in value.values() if isinstance(v, (dict, list)) for t in walk(v)]
    return []


def test_untyped_samples_of_any_shape(spark):
    def sample(rnd, depth=0):
        kind = rnd.random()
        if depth > 3 or kind < 0.35:
            return rnd.choice(["plain text", "  spaced ", "", '{"text": "looks like an object"}', "[1, 2]", "42", "null", "é \"quoted\""])
        if kind < 0.5:
            return rnd.choice([None, 3, 2.5, True])
        if kind < 0.75:
            return [sample(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
        keys = rnd.sample(["text", "title", "content", "zeta", "alpha", "nested key", "passage", "wikipedia", "it's"], rnd.randint(0, 5))
        return {k: sample(rnd, depth + 1) for k in keys}
    rnd = random.Random(6)
    samples = [{f: sample(rnd) for f in rnd.sample(list(S.EVIDENCE_FIELDS) + ["other"], 4)} for _ in range(60)]
    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(samples)] + [(100, "no json"), (101, None), (102, "[1]"), (103, "{}")]
    got = explode_untyped_evidence(spark.createDataFrame(rows, "pos long, json string"), "json").collect()
    want = {(i << 32) + (f << 28) + j: t for i, x in enumerate(samples) for f, name in enumerate(S.EVIDENCE_FIELDS) for j, t in enumerate(walk(x.get(name)))}
    assert {r.pos: r.text for r in got} == want and len(got) == len(want) > 100


def test_projections_reach_the_recall(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(1200, 16))
    x[600:900] = x[0]                                     # copies in one bucket
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(2)
    ask = df.where("id % 10 = 0")
    counter = spark.sparkContext.accumulator(0)
    got = {}
    for r in projected_knn(ask, df, 5, qid="id", cid="id", exclude_self=True, bucket_rows=20, counter=counter).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    hits = total = 0
    for i in range(0, 1200, 10):
        d = np.round(((x - x[i]) ** 2).sum(1), 9)
        near = set(sorted((j for j in range(1200) if j != i), key=lambda j: (d[j], j))[:5])
        hits, total = hits + len(near & got.get(i, set())), total + 5
    assert hits >= 0.9 * total
    assert projected_knn(ask, df.limit(0), 5, qid="id", cid="id").count() == 0


@pytest.mark.parametrize("name", ["untyped_evidence", "needle_metrics", "first_questions", "smoke_documents", "long_document_corpus",
                                  "memory_breakdown", "error_summary", "run_files"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    df = search_queries.REGISTRY[name](spark, SF0001)
    columns = sorted(df.columns)
    want = con.sql(search_oracles.ORACLES[name]).select(", ".join(columns)).fetchall()
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


def test_grams_of_a_long_text_are_not_cut_out_one_by_one(spark):
    from pyspark.sql import functions as F
    from sparkrecall.operators.needles import query_metrics_table
    text = "".join(chr(97 + i * i % 26) for i in range(3000)) + " \U0001f600néedle"
    log = spark.createDataFrame([(1, text, "memory", 0.5, 2.0), (2, "other", "memory", 0.1, 1.0)],
                                "seq long, query string, source string, confidence double, latency double").withColumns(
        {c: F.lit(1) for c in ("memory_size", "retrieval_count", "memory_count")}).withColumn("timestamp", F.lit(None).cast("timestamp"))
    needles = spark.createDataFrame([("\U0001f600né",), ("éE",), ("O",), ("zzzz",), (" ",)], "needle string")
    out = query_metrics_table(log, needles)
    assert "substring" not in out._jdf.queryExecution().analyzed().toString()
    assert {(r.query, r.matches) for r in out.collect()} == {("\U0001f600né", 1), ("éE", 1), ("O", 2 if "o" in text else 1)}
