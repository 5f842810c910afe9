"""Routing fixpoint == the sequential one-query-at-a-time cache loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.operators.routing import route_decisions

SF = "/root/testdata/sf0.001"


def sequential(vecs, t, pre=None):
    """The reference loop: top-1 inner product over stored unit vectors."""
    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n > 0 else v * 0
    store = [unit(np.asarray(v, dtype=np.float64)) for v in (pre or [])]
    out = []
    for v in vecs:
        u = unit(np.asarray(v, dtype=np.float64))
        if not store:
            out.append(("retrieval", None, 0.0, len(store)))
            store.append(u)
            continue
        sims = np.array([u @ s for s in store])
        best = int(np.lexsort((np.arange(len(sims)), -np.round(sims, 9)))[0])
        if sims[best] >= t:
            out.append(("memory", best, float(sims[best]), None))
        else:
            out.append(("retrieval", best, float(sims[best]), len(store)))
            store.append(u)
    return out


@pytest.fixture(scope="module")
def emb(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return rows


def _check(got, want, ids):
    assert len(got) == len(want)
    for vid, w in zip(ids, want):
        g = got[vid]
        assert (g["source"], g["memory_id"], g["stored_id"]) == (w[0], w[1], w[3]), vid
        assert g["confidence"] == pytest.approx(w[2], abs=1e-9)


@pytest.mark.parametrize("t", [0.55, 0.45, 0.35, 0.25])
def test_fixpoint_equals_sequential(spark, emb, t):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r["seq"]: r for r in route_decisions(df, t, seq="vec_id", vec="embedding").collect()}
    _check(got, sequential([r["embedding"] for r in emb], t), [r["vec_id"] for r in emb])


def test_preloaded_memory_and_grid_path(spark, emb):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pre = df.filter(F.col("vec_id") < 100).select(F.col("vec_id").alias("id"),
                                                   F.col("embedding").alias("query_embedding"))
    q = df.filter(F.col("vec_id") >= 100)
    got = {r["seq"]: r for r in route_decisions(q, 0.35, seq="vec_id", vec="embedding", preloaded=pre,
                                                broadcast_rows=0).collect()}
    pre_v = [r["embedding"] for r in emb if r["vec_id"] < 100]
    rest = [r for r in emb if r["vec_id"] >= 100]
    want = sequential([r["embedding"] for r in rest], 0.35, pre_v)
    _check(got, want, [r["vec_id"] for r in rest])
    assert sum(1 for w in want if w[0] == "memory") > 0


def test_empty_memory_first_query(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [0.0, 0.0])], "seq long, vec array<double>")
    got = {r["seq"]: r for r in route_decisions(df, 0.55).collect()}
    assert (got[5]["source"], got[5]["confidence"], got[5]["memory_id"]) == ("retrieval", 0.0, None)
    assert (got[7]["source"], got[7]["memory_id"]) == ("memory", 0)
    assert got[9]["source"] == "retrieval" and got[9]["stored_id"] == 1   # zero vector: cosine 0
