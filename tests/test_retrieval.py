"""The reference's ten retriever checks as assertions, on our own corpus, plus
hybrid top-k against a brute-force (all documents scored) Python version."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkrecall.functions.embed import _token_slot
from sparkrecall.operators.hybrid import hit_at_k, retrieval_checks
from sparkrecall.plans.pipeline import build_index, hybrid_retrieve

DOCS = [
    "An array stores elements in contiguous memory locations for constant time indexing.",
    "A heap is a tree based structure where every parent orders before its children.",
    "Tries store strings character by character to support fast prefix lookups.",
    "Merge sort splits the input in halves, sorts each half and merges the results.",
    "Quick sort partitions around a pivot and recursively sorts both partitions.",
    "Breadth first search visits graph vertices level by level using a queue.",
    "Depth first search explores a graph branch fully before backtracking.",
    "Memoization caches results of expensive calls so repeated inputs are cheap.",
    "A bloom filter answers set membership with possible false positives.",
    "Union find tracks disjoint sets with near constant time merge operations.",
]


def embed_py(text, dim=64):
    v = [0.0] * dim
    for t in text.lower().split():
        b, s = _token_slot(t, dim)
        v[b] += s
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else v


def brute_hybrid(query, k, wb, wd):
    toks = [d.lower().split() for d in DOCS]
    n = len(toks)
    avgdl = sum(map(len, toks)) / n
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: (eps if v < 0 else v) for t, v in idf.items()}
    q = query.lower().split()
    bm = []
    for d in toks:
        tf = Counter(d)
        bm.append(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in q))
    mx = max(bm)
    if mx > 0:
        bm = [x / mx for x in bm]
    qv = embed_py(query)
    dist = [sum((a - b) ** 2 for a, b in zip(qv, embed_py(d))) for d in DOCS]
    cand = sorted(range(n), key=lambda i: (round(dist[i], 9), i))[:2 * k]
    dense = [0.0] * n
    for i in cand:
        dense[i] = 1 / (1 + dist[i])
    mx = max(dense)
    dense = [x / mx for x in dense] if mx > 0 else dense
    h = [wb * a + wd * b for a, b in zip(bm, dense)]
    return sorted(range(n), key=lambda i: (-round(h[i], 9), i))[:k]


QUERIES = ["how does quick sort use a pivot", "graph traversal level by level queue",
           "zzz qqq unknown tokens", "caching repeated expensive function calls", "prefix lookup on strings"]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "chunk_id long, text string")
    return build_index(chunks)


def _queries(spark):
    from sparkrecall.functions.embed import embed
    q = spark.createDataFrame([(i, t) for i, t in enumerate(QUERIES)], "query_id long, query string")
    return embed(q, "query", out_col="qvec")


@pytest.mark.parametrize("k,wb,wd", [(1, .5, .5), (2, .5, .5), (4, .5, .5), (3, .8, .2), (3, .2, .8),
                                     (3, 1.0, 0.0), (3, 0.0, 1.0), (12, .5, .5)])
def test_hybrid_equals_bruteforce(spark, index, k, wb, wd):
    res = hybrid_retrieve(_queries(spark), index, k=k, bm25_weight=wb, dense_weight=wd)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i, q in enumerate(QUERIES):
        assert got[i] == brute_hybrid(q, min(k, len(DOCS)), wb, wd), (q, k, wb, wd)
    chk = retrieval_checks(res, min(k, len(DOCS))).collect()
    assert all(r["exact_k"] and r["no_duplicates"] for r in chk) and len(chk) == len(QUERIES)


def test_keyword_relevance(spark, index):
    res = hybrid_retrieve(_queries(spark), index, k=2).join(index.chunks, "chunk_id")
    hits = {r["query_id"]: r["hit"] for r in hit_at_k(res, ["pivot", "queue", "memoization", "tries"]).collect()}
    assert hits[0] and hits[1] and hits[3] and hits[4]


def test_unscored_chunks_beat_negative_scores(spark):
    """A term in most chunks scores below zero; the lowest ids without it must win."""
    texts = ["apple one", "apple two", "apple three", "apple four", "apple five", "apple six", "pear", "plum", "fig"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    idx = build_index(chunks)
    from sparkrecall.functions.embed import embed
    q = embed(spark.createDataFrame([(0, "apple"), (1, "apple apple fig"), (2, "nothing known")], "query_id long, query string"), "query",
              out_col="qvec")
    got = {}
    for r in hybrid_retrieve(q, idx, k=3, bm25_weight=1.0, dense_weight=0.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    df = {"apple": 6, "fig": 1}
    n, avgdl = 9, 15 / 9
    idf = {t: math.log(n - c + .5) - math.log(c + .5) for t, c in {**df, "one": 1, "two": 1, "three": 1, "four": 1, "five": 1, "six": 1, "pear": 1,
                                                                     "plum": 1}.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    assert idf["apple"] < 0 < floor  # floored, so positive here: apples win
    assert [c for c, _ in got[0]] == [0, 1, 2]
    assert got[2] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert got[1][0][0] == 8


def test_padding_with_a_negative_floor(spark):
    """When most terms are in most chunks the mean idf, and with it the floor, is negative."""
    texts = ["a b c", "a b c", "a b c", "a b c", "a b", "a", "x", "y", "z a b c"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    from sparkrecall.operators.bm25 import build_bm25, bm25_scores
    from sparkrecall.operators.hybrid import hybrid_top_k
    idx = build_bm25(chunks, epsilon=-0.25)  # any negative factor gives negative scores for common terms
    q = spark.createDataFrame([(0, "a"), (1, "a x")], "query_id long, query string")
    s = bm25_scores(idx, q)
    top = hybrid_top_k(s, None, q.select("query_id"), chunks.selectExpr("chunk_id as doc_id"), k=3, bm25_weight=1.0)
    got = {}
    for r in top.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"] >= 0))
    scores = {(r["query_id"], r["doc_id"]): r["bm25"] for r in s.collect()}
    for query in (0, 1):
        want = sorted(range(9), key=lambda d: (-round(scores.get((query, d), 0.0) / max(1e-12, max(
            [v for (k, _), v in scores.items() if k == query] + [0]) or 1), 9), d))[:3]
        assert [d for d, _ in got[query]] == want


def test_padding_beyond_the_first_window(spark):
    """Ids that are taken or scored fill the first windows of ranks: the next ones are read."""
    from sparkrecall.operators.hybrid import hybrid_top_k
    ids = [10 * i for i in range(60)]
    scores = spark.createDataFrame([(0, d, -1.0) for d in ids[:50]] + [(1, ids[0], 2.0), (2, ids[1], -1.0)], "query_id long, doc_id long, bm25 double")
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_id long")
    rows = hybrid_top_k(scores, None, queries, spark.createDataFrame([(d,) for d in ids], "doc_id long"), k=3).collect()
    got = {q: [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(4)}
    assert got == {0: [500, 510, 520], 1: [0, 10, 20], 2: [0, 20, 30], 3: [0, 10, 20]}
