"""Pivot-pruned joins == brute force, with copies, ties, odd vectors and hot cells."""

import numpy as np
import pytest

from sparkrecall.operators import pivots as P
from sparkrecall.operators.knn import knn
from sparkrecall.operators.routing import route_decisions, stored_set
from test_routing import sequential


def clustered(n=600, d=8, clusters=12, spread=0.05, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, d))
    x = centres[rnd.integers(clusters, size=n)] + spread * rnd.normal(size=(n, d))
    return np.round(x, 3)


def frame(spark, x, name, ids=None):
    ids = ids if ids is not None else range(len(x))
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)],
                                 f"{name} long, vec array<double>").repartition(2)


def brute(q, c, k, qids, cids, only_earlier=False, exclude_self=False):
    out = set()
    for i, v in zip(qids, q):
        found = [(round(float(((v - w) ** 2).sum()), 9), int(j)) for j, w in zip(cids, c)
                 if not (only_earlier and j >= i) and not (exclude_self and j == i)]
        out |= {(int(i), j, r + 1) for r, (_, j) in enumerate(sorted(found)[:k])}
    return out


def got(df):
    return {(r.query_id, r.doc_id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("mode", [{}, {"exclude_self": True}, {"only_earlier": True}])
def test_knn_equals_brute_force(spark, monkeypatch, mode):
    monkeypatch.setattr(P, "GRID_CORPUS_BLOCK", 40)    # cells and their queries in several blocks
    monkeypatch.setattr(P, "GRID_QUERY_BLOCK", 30)
    x = clustered(180)
    x[60:120] = x[7]                                   # one vector of a third of all rows
    x[150:158] = 0
    if mode:
        q, qids = x, np.arange(180) * 3
        queries, corpus = frame(spark, x, "query_id", qids), frame(spark, x, "doc_id", qids)
    else:
        q, qids = np.vstack([clustered(40, seed=2), x[5:9], x[5:7], np.zeros((1, 8)), 1e6 * np.ones((1, 8))]), np.arange(48)
        queries, corpus = frame(spark, q, "query_id"), frame(spark, x, "doc_id", np.arange(180) * 3)
    want = brute(q, x, 4, qids, np.arange(180) * 3, **mode)
    assert got(P.pivot_knn(queries, corpus, 4, cell_rows=20, **mode)) == want


def test_knn_compares_few_pairs_of_clustered_rows(spark):
    x = clustered(1500, clusters=40)
    counter = spark.sparkContext.accumulator(0)
    e = frame(spark, x, "query_id")
    found = P.pivot_knn(e, e, 3, cid="query_id", exclude_self=True, cell_rows=30, counter=counter)
    assert got(found) == got(knn(e, e, 3, cid="query_id", exclude_self=True, broadcast_rows=0))
    assert counter.value < 0.3 * 1500 * 1500


def test_nulls_and_empty_tables(spark):
    some, none = frame(spark, [[1.0, 2.0], None, [1.0, 2.5]], "query_id"), frame(spark, [], "doc_id")
    assert P.pivot_knn(some, none, 2).count() == 0
    assert P.pivot_knn(none.withColumnRenamed("doc_id", "query_id"), some.withColumnRenamed("query_id", "doc_id"), 2).count() == 0
    assert got(P.pivot_knn(some, some.withColumnRenamed("query_id", "doc_id"), 2)) == {(0, 0, 1), (0, 2, 2), (2, 2, 1), (2, 0, 2)}


@pytest.mark.parametrize("t", [0.9, 0.0, 1.0])
def test_routing_with_dense_clusters_and_copies(spark, t):
    x = clustered(260, d=4, clusters=5, spread=0.2, seed=4)
    x[100:180] = x[3]
    x[[0, 50, 220]] = 0
    df = frame(spark, x, "seq")
    units, status, rounds = stored_set(df, t, cell_rows=25, most=2)    # short lists are filled up again
    want = sequential(list(x), t)
    near_one = t == 1.0   # copies agree to rounding only
    if not near_one:
        assert {r.seq for r in status.collect() if r.status == "S"} == {i for i, w in enumerate(want) if w[3] is not None}
        out = {r.seq: r for r in route_decisions(df, t, cell_rows=25).collect()}
        assert [(out[i].source, out[i].memory_id, out[i].stored_id) for i in range(260)] == [(a, b, d) for a, b, _, d in want]
    assert status.count() == 260 and rounds <= 40


def test_a_dense_cluster_costs_a_few_links_a_row(spark):
    rnd = np.random.default_rng(0)
    x = np.vstack([rnd.normal(size=(300, 6)), np.ones((300, 6)) + 0.01 * rnd.normal(size=(300, 6))])
    nodes = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True), "id")
    placed, cells = P.into_cells(nodes, 50)
    from pyspark.sql import functions as F
    links = P.earlier_neighbours(nodes.withColumn("after", F.lit(-2**63)), placed, cells, 0.95, 3)
    per_row = {r.query_id: r["count"] for r in links.groupBy("query_id").count().collect()}
    assert max(per_row.values()) == 3 and len(per_row) >= 299
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(600) for j in np.flatnonzero(u[:i] @ u[i] >= 0.95)[:3]}
    assert {(r.query_id, r.doc_id) for r in links.collect()} == want


def test_vectors_are_not_shuffled_once_per_cell(spark):
    x = np.random.default_rng(3).normal(size=(400, 16))   # nothing can be pruned: every query asks every cell
    corpus = frame(spark, x, "id")
    placed, cells = P.into_cells(corpus, 20)
    found = P.search_cells(corpus.select(P.F.col("id").alias("query_id"), P.F.col("vec").alias("qv")), placed, cells, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroups" not in plan and "Exchange hashpartitioning" not in plan
    assert got(P.top_k(found, 3, score="dist", ascending=True)) == brute(x, x, 3, range(400), range(400))


def test_nearest_rows_beyond_one_merge(spark, monkeypatch):
    x = np.repeat(np.random.default_rng(4).normal(size=(60, 4)), 3, axis=0)   # ties throughout
    monkeypatch.setattr(P, "_PENDING", 5)
    block = {"q_ids": np.arange(180), "q_vecs": x, "q_reach": np.full(180, np.inf), "q_asks": np.full((180, 1), 128, np.uint8), "q_after": np.zeros(0, np.int64)}
    asking = P._NearestRows({k: v.tobytes() for k, v in block.items()}, x[:1].copy(), 4, False, None)
    ring = np.sqrt(((x - x[0])**2).sum(1))
    by = np.argsort(ring, kind="stable")
    for part in np.array_split(by, 3):
        asking.meet(P._CorpusBlock([0], np.array([0, len(part)]).tobytes(), part.astype(np.int64).tobytes(), x[part].tobytes(), ring[part].tobytes()))
    who, ids, d = asking.rest()
    found = {(int(q), int(i)) for q, i in zip(who, ids)}
    assert found == {(q, i) for q, i, _ in brute(x, x, 4, range(180), range(180))}
