"""Exact k-nearest-neighbour join between a query table and a corpus table of
array<double> vectors, without emitting all pairs.

* Query side proven small (bounded count): the query matrix is broadcast and
  every corpus partition keeps a running per-query top-k across its Arrow
  batches (``mapInPandas``); only k rows per query per partition are shuffled.
* Otherwise: a grid of (query block, corpus block) cells, ids hashed to blocks
  (data-independent, so no hot cell); each cell is a ``cogroup`` whose NumPy
  product keeps per-query top-k.
Both finish with a per-query ``row_number() <= k`` (partial WindowGroupLimit
before the shuffle).

Ranking is by (distance rounded to 9 decimals, id) in both phases, so ties are
broken identically everywhere (lowest id wins).

Metrics: ``l2sq`` squared Euclidean distance (smaller is nearer) and ``ip``
inner product (larger is nearer; use on unit vectors for cosine).
``only_earlier`` keeps pairs with corpus id < query id (as-of neighbours).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import RANK_DECIMALS, top_k

# Query rows broadcast to every corpus partition at most.
QUERY_BROADCAST_ROWS = 4096
# Target rows per block in the grid path.
GRID_QUERY_BLOCK = 4096
GRID_CORPUS_BLOCK = 16384
# Corpus rows multiplied at once, and distances held at once on the broadcast path
# (bound the Q x B distance matrix and its copies).
CHUNK_ROWS, CHUNK_PAIRS = 8192, 1 << 20

OUT_SCHEMA = "query_id long, doc_id long, dist double"


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Ranking key, smaller is nearer: squared L2, or negated inner product."""
    ip = q @ c.T
    if metric == "ip":
        return -ip
    qn = (q * q).sum(1)[:, None]
    cn = (c * c).sum(1)[None, :]
    return np.maximum(qn + cn - 2.0 * ip, 0.0)


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest columns of each row; columns are in id order, so of equal
    distances (as ranked) those with the lowest ids are taken."""
    if d.shape[1] <= k:
        return d, ids
    key = np.round(d, RANK_DECIMALS)
    kth = np.partition(key, k - 1, axis=1)[:, k - 1:k]
    below, tied = key < kth, key == kth
    room = k - below.sum(1, keepdims=True)
    rows, cols = np.nonzero(below | (tied & (np.cumsum(tied, axis=1) <= room)))
    cols = cols.reshape(len(d), k)
    return np.take_along_axis(d, cols, 1), np.take_along_axis(ids, cols, 1)


class _TopK:
    """Running per-query top-k over streamed corpus blocks."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.best_d = np.full((len(qids), 0), np.inf)
        self.best_i = np.zeros((len(qids), 0), dtype=np.int64)

    def update(self, d: np.ndarray, ids: np.ndarray):
        """Fold in a block of distances (queries x rows), all queries at once: the
        block is cut to its own k nearest, then merged with the k held so far."""
        if d.shape[1] == 0:
            return
        by_id = np.argsort(ids, kind="stable")
        d, i = _nearest(d[:, by_id], np.broadcast_to(ids[by_id], d.shape), self.k)
        d, i = np.concatenate([self.best_d, d], axis=1), np.concatenate([self.best_i, i], axis=1)
        order = np.lexsort((i, np.round(d, RANK_DECIMALS)), axis=1)[:, :self.k]
        self.best_d, self.best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    def frame(self, metric: str) -> pd.DataFrame:
        mask = np.isfinite(self.best_d)
        rows = np.nonzero(mask)
        d = self.best_d[rows]
        return pd.DataFrame({"query_id": self.qids[rows[0]].astype(np.int64),
                             "doc_id": self.best_i[rows].astype(np.int64),
                             "dist": (-d if metric == "ip" else d).astype(np.float64)})


def _mask(d: np.ndarray, qids: np.ndarray, cids: np.ndarray, only_earlier: bool, exclude_self: bool):
    if only_earlier:
        d[cids[None, :] >= qids[:, None]] = np.inf
    elif exclude_self:
        d[cids[None, :] == qids[:, None]] = np.inf
    return d


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


def knn(queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "l2sq",
        qid: str = "query_id", qvec: str = "vec", cid: str = "doc_id", cvec: str = "vec",
        only_earlier: bool = False, exclude_self: bool = False,
        broadcast_rows: int = QUERY_BROADCAST_ROWS) -> DataFrame:
    """(query_id, doc_id, dist, rank) for the k nearest corpus rows of each query.
    ``dist`` is the squared L2 distance (l2sq) or the inner product (ip)."""
    q = queries.select(F.col(qid).cast("long").alias("query_id"), F.col(qvec).alias("qv"))
    c = corpus.select(F.col(cid).cast("long").alias("doc_id"), F.col(cvec).alias("cv"))
    rows = q.limit(broadcast_rows + 1).collect() if broadcast_rows > 0 else None
    if rows is not None and len(rows) <= broadcast_rows:   # proven small: at most the bound is fetched
        cand = _broadcast_knn(q, rows, c, k, metric, only_earlier, exclude_self)
    else:
        cand = _grid_knn(q, c, k, metric, only_earlier, exclude_self)
    key = F.col("dist") if metric == "l2sq" else -F.col("dist")
    ranked = top_k(cand.withColumn("_key", key), k, group="query_id", score="_key", id_col="doc_id",
                   ascending=True)
    return ranked.drop("_key")


def _broadcast_knn(q, rows, c, k, metric, only_earlier, exclude_self) -> DataFrame:
    spark = q.sparkSession
    qids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    qmat = (np.vstack([np.asarray(r["qv"], dtype=np.float64) for r in rows]) if rows
            else np.zeros((0, 0)))
    bq = spark.sparkContext.broadcast((qids, qmat))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi, qm = bq.value
        acc = _TopK(qi, k)
        step = max(1, min(CHUNK_ROWS, CHUNK_PAIRS // max(1, len(qi))))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                blk = pdf.iloc[s:s + step]
                if len(qi) == 0 or len(blk) == 0:
                    continue
                ids = blk["doc_id"].to_numpy(np.int64)
                d = _mask(_distances(qm, _stack(blk["cv"]), metric), qi, ids, only_earlier, exclude_self)
                acc.update(d, ids)
        yield acc.frame(metric)

    return c.mapInPandas(part, OUT_SCHEMA)


def _grid_knn(q, c, k, metric, only_earlier, exclude_self) -> DataFrame:
    n_q = q.count()
    n_c = c.count()
    qb = max(1, math.ceil(n_q / GRID_QUERY_BLOCK))
    cb = max(1, math.ceil(n_c / GRID_CORPUS_BLOCK))
    qrep = q.select("query_id", "qv", (F.abs(F.xxhash64("query_id")) % qb).alias("qb"),
                    F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"))
    crep = c.select("doc_id", "cv", (F.abs(F.xxhash64("doc_id")) % cb).alias("cb"),
                    F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "dist": []}).astype(
                {"query_id": "int64", "doc_id": "int64", "dist": "float64"})
        qi = qpdf["query_id"].to_numpy(np.int64)
        qm = _stack(qpdf["qv"])
        acc = _TopK(qi, k)
        for s in range(0, len(cpdf), CHUNK_ROWS):
            blk = cpdf.iloc[s:s + CHUNK_ROWS]
            ids = blk["doc_id"].to_numpy(np.int64)
            acc.update(_mask(_distances(qm, _stack(blk["cv"]), metric), qi, ids, only_earlier, exclude_self), ids)
        return acc.frame(metric)

    return (qrep.groupBy("qb", "cb").cogroup(crep.groupBy("qb", "cb"))
            .applyInPandas(cell, OUT_SCHEMA))
