"""Approximate k nearest neighbours by multi-probe random projections.

Signs of projections on random directions put every corpus row into one of 2^bits
buckets. A query probes the buckets in order of the squared margins that it would have
to cross, as many as ``probes`` says; the rows of probed buckets are compared by true
distance. ``calibrate`` sets ``probes`` for a wanted recall from a bounded sample of
queries that are also searched exactly. Every row is in a bucket, and buckets, like the
cells of ``pivots``, are dealt over blocks, so a hot one is many tasks; copies of a
vector collapse as they do there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import CHUNK_ROWS, OUT_SCHEMA, _stack
from .pivots import Cells, _ask, _knn_compare, lowest_copies, pivot_knn
from .topk import top_k

#: Rows of a bucket aimed at, and bits at most (a query orders all its buckets).
BUCKET_ROWS, MOST_BITS = 4096, 10
#: Queries that the number of probes is set by.
SAMPLE = 256


@dataclass(frozen=True)
class Projection:
    """Directions (bits x dimension) and the values that part each of them in two."""
    directions: np.ndarray
    middle: np.ndarray

    def sides(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions.T - self.middle

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return (self.sides(x) >= 0) @ (1 << np.arange(len(self.middle)))

    def order(self, x: np.ndarray) -> np.ndarray:
        """The buckets of each row, nearest first."""
        bits = len(self.middle)
        flips = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
        cost = np.square(self.sides(x)) @ flips.T
        return self.bucket(x)[:, None] ^ np.argsort(cost, axis=1, kind="stable")


def projection(sample: np.ndarray, rows: int, bucket_rows: int = BUCKET_ROWS, seed: int = 0) -> Projection:
    """Random directions, each parted at the median of the sample."""
    bits = max(0, min(MOST_BITS, math.ceil(math.log2(max(1, rows / bucket_rows)))))
    directions = np.random.default_rng(seed).normal(size=(bits, sample.shape[1]))
    return Projection(directions, np.median(sample @ directions.T, axis=0) if bits else np.zeros(0))


def _vectors(df: DataFrame, id_col: str, vec: str, names: tuple[str, str]) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(names[0]), F.col(vec).cast("array<double>").alias(names[1]))


def calibrate(plan: Projection, queries: DataFrame, corpus: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> int:
    """Probes with which ``recall`` of the sampled queries' true neighbours are found:
    (query_id, qv) rows drawn by a hash of their ids, searched exactly."""
    drawn = cut_lineage(queries.orderBy(F.xxhash64("query_id", F.lit(3)), "query_id").limit(sample))
    true = pivot_knn(drawn, corpus, k, qvec="qv", cid="id", cvec="vec")
    pairs = true.join(drawn, "query_id").join(corpus.select(F.col("id").alias("doc_id"), "vec"), "doc_id").select("qv", "vec").collect()  # sample * k rows
    if not pairs or not len(plan.middle):
        return 1
    q, c = (_stack(pd.Series([r[i] for r in pairs])) for i in (0, 1))
    at = (plan.order(q) == plan.bucket(c)[:, None]).argmax(1)
    return int(np.sort(at)[min(len(at) - 1, math.ceil(recall * len(at)) - 1)]) + 1


def projected_knn(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "query_id", qvec: str = "vec", cid: str = "doc_id",
                  cvec: str = "vec", exclude_self: bool = False, probes: int | None = None, recall: float = 0.95,
                  bucket_rows: int = BUCKET_ROWS, seed: int = 0, counter: Accumulator | None = None) -> DataFrame:
    """(query_id, doc_id, dist, rank): of the k nearest corpus rows of each query by
    squared L2 distance, those in the probed buckets. Without ``probes`` they are
    calibrated for ``recall``."""
    spark = queries.sparkSession
    wanted = k + 1 if exclude_self else k
    rows = cut_lineage(lowest_copies(_vectors(corpus, cid, cvec, ("id", "vec")), wanted))
    asking = cut_lineage(_vectors(queries, qid, qvec, ("query_id", "qv")))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(4 * SAMPLE).collect()
    if not drawn:
        return spark.createDataFrame([], OUT_SCHEMA + ", rank int")
    plan = projection(_stack(pd.Series([r.vec for r in drawn])), rows.count(), bucket_rows, seed)
    if probes is None:
        probes = calibrate(plan, asking, rows, wanted, recall)
    held = spark.sparkContext.broadcast(plan)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(cell=held.value.bucket(_stack(pdf["vec"])).astype(np.int32) if len(pdf) else [], ring=0.0)

    def probe(batches):
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS // 8):
                part = pdf.iloc[s:s + CHUNK_ROWS // 8]
                near = held.value.order(_stack(part["qv"]))[:, :probes].astype(np.int32)
                yield part.assign(reach=np.inf, cells=near.tolist())

    placed = cut_lineage(rows.mapInPandas(place, "id long, vec array<double>, cell int, ring double"))
    n = 1 << len(plan.middle)
    size = np.zeros(n, np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():   # one row per bucket
        size[r.cell] = r.n
    middle = np.zeros((n, len(drawn[0].vec)))   # every row is at ring 0 of its bucket, so that none is skipped
    cells = Cells(middle, np.zeros((n, n)), size, np.zeros(n), np.zeros(n))
    asked = cut_lineage(asking.mapInPandas(probe, "query_id long, qv array<double>, reach double, cells array<int>"))
    asked = asked.select("query_id", "qv", "reach", F.explode("cells").alias("cell"))
    found = _ask(asked, placed, cells, _knn_compare(spark.sparkContext.broadcast(middle), wanted, False, counter), OUT_SCHEMA)
    if exclude_self:
        found = found.where("query_id != doc_id")
    return top_k(found, k, score="dist", ascending=True)
