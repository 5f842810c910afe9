"""Similarity joins pruned by pivots (metric cells), exact for every input.

A few corpus rows drawn by a hash of their ids are the pivots. Every corpus row belongs
to the cell of its nearest pivot and knows its distance to it; a cell is described by
its size and its least and largest such distance. By the triangle inequality a query
can only meet rows within ``reach`` in cells whose ring around the pivot, and whose side
of the bisecting plane, comes that close; inside a cell only the rows whose own ring
distance does are compared. Only the pivots and one description per cell reach the
driver (``MOST_PIVOTS`` of each at most).

* ``pivot_knn``: a query first searches its home cell; its k-th distance there is the
  reach with which it asks the other cells.
* ``earlier_neighbours``: the first few earlier rows at a cosine of at least t.

Both sides are written once as blocks, one row of packed arrays each: small cells share
a block and a large one is dealt over several by a hash of the ids. The join is a
product of the block tables with the blocks that nobody asks left out, so vectors are
read where they are compared and never shuffled once per cell; what is shuffled and
written grows with the rows. Where distances say nothing (random directions in many
dimensions) every cell is asked and the join is the plain grid of blocks.

Copies of one vector are collapsed first: of equal corpus vectors only the rows with
the lowest ids can be among the k nearest (ties go to lower ids, and an earlier copy
is earlier for everyone), and equal query vectors are searched once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import CHUNK_ROWS, GRID_CORPUS_BLOCK, GRID_QUERY_BLOCK, OUT_SCHEMA, _stack, _TopK
from .topk import RANK_DECIMALS, top_k

#: Rows of a cell aimed at, and pivots at most (their matrix is broadcast).
CELL_ROWS, MOST_PIVOTS = 4096, 1024
#: Slack of all bounds, by the size of the vectors: more than the rounding by which
#: neighbours are ranked.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Pivots (rows of ``pivots``), the distances between them, and per cell its rows
    and its least and largest distance to the pivot (no rows: never asked)."""
    pivots: np.ndarray
    between: np.ndarray
    size: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def bounds(self, to_pivots: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each query (row) to the rows of each cell."""
        ring = np.maximum(to_pivots - self.outer, self.inner - to_pivots)
        near = np.take_along_axis(to_pivots, home[:, None], 1)
        apart = self.between[home]
        plane = np.where(apart > 0, (to_pivots**2 - near**2) / (2 * np.where(apart > 0, apart, 1.0)), 0.0)
        out = np.maximum(np.maximum(ring, plane), 0.0)
        out[:, self.size == 0] = np.inf
        return out


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows x pivots), by differences: squares of nearly equal vectors cancel."""
    out = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T), 0.0))
    close = np.argwhere(out < 1e-3)
    for i, j in close:
        out[i, j] = np.linalg.norm(x[i] - pivots[j])
    return out


def _slack(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    largest = float(np.sqrt((pivots * pivots).sum(1)).max())
    return SLACK * np.maximum(max(1.0, largest), np.sqrt((x * x).sum(1)))


def draw_pivots(corpus: DataFrame, rows: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Different vectors of up to ``MOST_PIVOTS`` rows of (id, vec), drawn by a hash of the id."""
    n = max(1, min(MOST_PIVOTS, math.ceil(rows / cell_rows)))
    drawn = corpus.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(n).collect()
    return np.unique(_stack(pd.Series([r.vec for r in drawn])), axis=0) if drawn else np.zeros((0, 0))


def place(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vec, cell, ring) of (id long, vec array<double>) rows: the nearest pivot and the distance to it."""
    held = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS):
                part = pdf.iloc[s:s + CHUNK_ROWS]
                d = _to_pivots(_stack(part["vec"]), held.value)
                home = d.argmin(1)
                yield part.assign(cell=home.astype(np.int32), ring=np.take_along_axis(d, home[:, None], 1)[:, 0])

    return corpus.select("id", "vec").mapInPandas(assign, "id long, vec array<double>, cell int, ring double")


def describe(placed: DataFrame, pivots: np.ndarray) -> Cells:
    """The cells of placed rows: one row per cell reaches the driver."""
    n = len(pivots)
    size, inner, outer = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("ring").alias("a"), F.max("ring").alias("b")).collect():
        size[r.cell], inner[r.cell], outer[r.cell] = r.n, r.a, r.b
    return Cells(pivots, _to_pivots(pivots, pivots) if n else np.zeros((0, 0)), size, inner, outer)


def into_cells(corpus: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Cells]:
    """Written table (id, vec, cell, ring) of the rows (id long, vec array<double>), and its cells."""
    pivots = draw_pivots(corpus, corpus.count(), cell_rows)
    placed = cut_lineage(place(corpus, pivots))
    return placed, describe(placed, pivots)


def _blocks(rows: DataFrame, per_cell: dict[int, int], block: int, name: str, key: str) -> DataFrame:
    """``rows`` (with ``cell``) with a block number of their cell by a hash of ``key``."""
    parts = {c: math.ceil(n / block) for c, n in per_cell.items() if n > block}
    count = F.lit(1)
    if parts:
        count = F.coalesce(F.create_map(*[F.lit(v).cast("int") for kv in parts.items() for v in kv])[F.col("cell")], F.lit(1))
    return rows.withColumn(name, F.pmod(F.xxhash64(key), count).cast("int"))


def _ask(asked: DataFrame, placed: DataFrame, cells: Cells, compare, schema: str) -> DataFrame:
    """Every query row (query_id, qv, reach, cell, ...) meets the rows of its cell, block by block."""
    asked_per_cell = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    queries = _blocks(asked, asked_per_cell, GRID_QUERY_BLOCK, "qb", "query_id")
    corpus = _blocks(placed, dict(enumerate(cells.size.tolist())), GRID_CORPUS_BLOCK, "cb", "id")
    q_blocks = {c: math.ceil(n / GRID_QUERY_BLOCK) for c, n in asked_per_cell.items()}
    c_blocks = {c: math.ceil(n / GRID_CORPUS_BLOCK) for c, n in enumerate(cells.size.tolist()) if n}

    def copies(per_cell: dict[int, int], name: str):
        many = {c: n for c, n in per_cell.items() if n > 1}
        if not many:
            return F.lit(0).alias(name)
        last = F.coalesce(F.create_map(*[F.lit(v).cast("int") for kv in many.items() for v in kv])[F.col("cell")], F.lit(1)) - 1
        return F.explode(F.sequence(F.lit(0), last)).alias(name)

    queries = queries.select("*", copies(c_blocks, "cb"))
    corpus = corpus.select("*", copies(q_blocks, "qb"))
    return (queries.groupBy("cell", "qb", "cb").cogroup(corpus.groupBy("cell", "qb", "cb")).applyInPandas(compare, schema))


def _rows_in_reach(qp: np.ndarray, reach: np.ndarray, ring: np.ndarray) -> tuple[int, int]:
    """Range of rows (sorted by ring) that any of the queries, at distance ``qp`` from the pivot, can reach."""
    low, high = float((qp - reach).min()), float((qp + reach).max())
    return int(np.searchsorted(ring, low, "left")), int(np.searchsorted(ring, high, "right"))


_SLAB = 256
#: Rows of a block at least (but for the last), and rows in reach held before the k nearest are kept.
_LEAST_BLOCK, _PENDING = 256, 1 << 17


def _knn_compare(pivots, k: int, only_earlier: bool, counter: Accumulator | None):
    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "doc_id": [], "dist": []}).astype({"query_id": "int64", "doc_id": "int64", "dist": "float64"})
        c = c.sort_values("ring", kind="stable")
        ring, ids, cm = c["ring"].to_numpy(), c["id"].to_numpy(np.int64), _stack(c["vec"])
        qm = _stack(q["qv"])
        pivot = pivots.value[[q["cell"].iloc[0]]]
        qp = _to_pivots(qm, pivot)[:, 0]
        qi, reach = q["query_id"].to_numpy(np.int64), q["reach"].to_numpy(float) + _slack(qm, pivot)
        order = np.argsort(qp, kind="stable")   # queries at like distances share their slab of rows
        out = []
        for s in range(0, len(order), _SLAB):
            at = order[s:s + _SLAB]
            a, b = _rows_in_reach(qp[at], reach[at], ring)
            best = _TopK(qi[at], k)
            for lo in range(a, b, CHUNK_ROWS):
                hi = min(b, lo + CHUNK_ROWS)
                d = _squared(qm[at], cm[lo:hi])
                if counter is not None:
                    counter.add(d.size)
                if only_earlier:
                    d[ids[lo:hi][None, :] >= qi[at][:, None]] = np.inf
                best.update(d, ids[lo:hi])
            out.append(best.frame("l2sq"))
        return pd.concat(out)

    return compare


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _digest(vec: str) -> list:
    return [F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(1), vec).alias("h2")]


def lowest_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k rows (id, vec) with the lowest ids; a partial limit before
    the shuffle keeps a hot vector to k rows per task."""
    keyed = rows.select("id", "vec", *_digest("vec"))
    w = Window.partitionBy("h1", "h2").orderBy("id")
    return keyed.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("id", "vec")


def _dealt(rows: DataFrame, sizes: dict[int, int], most: int, cell: str, key: str) -> tuple[DataFrame, int]:
    """``rows`` with the number of their ``block``, and how many there are: blocks of
    ``most`` rows at most or about, fewer while the cores would have less than two each."""
    total, cores = sum(sizes.values()), rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(most, max(_LEAST_BLOCK, math.ceil(total / (2 * cores)))))
    first, parts_of, at, room = [0] * (max(sizes, default=0) + 1), [1] * (max(sizes, default=0) + 1), -1, 0
    for c, n in sorted(sizes.items()):
        parts = math.ceil(n / most)
        if n > room:
            at, room = at + 1, most
        first[c], parts_of[c] = at, parts
        at, room = (at + parts - 1, 0) if parts > 1 else (at, room - n)
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col(cell))  # noqa: E731  # one value per cell
    return rows.withColumn("block", (of(first) + F.pmod(F.xxhash64(key), of(parts_of))).cast("int")), at + 1


def _bits(ask: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(ask, axis=1)]


def _pack_queries(q: pd.DataFrame) -> pd.DataFrame:
    asks = np.frombuffer(b"".join(q["asks"]), np.uint8).reshape(len(q), -1)
    after = q["after"].to_numpy(np.int64) if "after" in q else np.zeros(0, np.int64)
    return pd.DataFrame({"q_block": [q["block"].iloc[0]], "q_cells": [np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(asks, 0))).astype(np.int32)],
                         "q_ids": [q["query_id"].to_numpy(np.int64).tobytes()], "q_vecs": [_stack(q["qv"]).tobytes()],
                         "q_reach": [q["reach"].to_numpy(float).tobytes()], "q_asks": [asks.tobytes()], "q_after": [after.tobytes()]})


def _pack_corpus(c: pd.DataFrame) -> pd.DataFrame:
    c = c.sort_values(["cell", "ring"], kind="stable")
    cells, starts = np.unique(c["cell"].to_numpy(np.int32), return_index=True)
    return pd.DataFrame({"cells": [cells], "starts": [np.append(starts, len(c)).astype(np.int64).tobytes()], "ids": [c["id"].to_numpy(np.int64).tobytes()],
                         "vecs": [_stack(c["vec"]).tobytes()], "ring": [c["ring"].to_numpy(float).tobytes()]})


def _corpus_blocks(placed: DataFrame, cells: Cells) -> DataFrame:
    """Written table of the placed rows, one row per block."""
    rows, n = _dealt(placed.select("id", "vec", "cell", "ring"), {c: n for c, n in enumerate(cells.size.tolist()) if n}, GRID_CORPUS_BLOCK, "cell", "id")
    return cut_lineage(rows.repartition(max(1, n), "block").groupBy("block").applyInPandas(
        _pack_corpus, "cells array<int>, starts binary, ids binary, vecs binary, ring binary"))


def _meet(asked: DataFrame, sizes: dict[int, int], corpus: DataFrame, asker, schema: str) -> DataFrame:
    """Every query row (query_id, qv, reach, home, asks: bits of cells [, after]) meets the
    rows of the cells it asks. ``asker`` makes the searching side of a block of queries,
    which sees one block of the corpus after the other."""
    rows, n = _dealt(asked, sizes, GRID_QUERY_BLOCK, "home", "query_id")
    queries = cut_lineage(rows.repartition(max(1, n), "block").groupBy("block").applyInPandas(
        _pack_queries, "q_block int, q_cells array<int>, q_ids binary, q_vecs binary, q_reach binary, q_asks binary, q_after binary"))
    columns = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        of, held = None, None
        for batch in batches:
            rows = batch.to_pydict()
            for i in range(batch.num_rows):
                if of != rows["q_block"][i]:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.rest()], names=columns)
                    of, held = rows["q_block"][i], asker({name: rows[name][i] for name in ("q_ids", "q_vecs", "q_reach", "q_asks", "q_after")})
                found = held.meet(_CorpusBlock(*(rows[name][i] for name in ("cells", "starts", "ids", "vecs", "ring"))))
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=columns)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.rest()], names=columns)

    return queries.crossJoin(corpus).where(F.arrays_overlap("q_cells", "cells")).mapInArrow(run, schema)


class _CorpusBlock:
    def __init__(self, cells, starts, ids, vecs, ring):
        self.cells, self.starts = cells, np.frombuffer(starts, np.int64)
        self.ids, self.ring = np.frombuffer(ids, np.int64), np.frombuffer(ring, float)
        self.vecs = np.frombuffer(vecs, float).reshape(len(self.ids), -1)

    def of_cells(self):
        return zip(self.cells, self.starts[:-1].tolist(), self.starts[1:].tolist())


class _Asking:
    """A block of queries."""

    def __init__(self, block: dict, pivots: np.ndarray):
        self.pivots, self.ids = pivots, np.frombuffer(block["q_ids"], np.int64)
        n = len(self.ids)
        self.vecs = np.frombuffer(block["q_vecs"], float).reshape(n, -1)
        self.reach, self.after = np.frombuffer(block["q_reach"], float), np.frombuffer(block["q_after"], np.int64)
        self.asks = np.unpackbits(np.frombuffer(block["q_asks"], np.uint8).reshape(n, -1), axis=1)

    def slabs(self, cell: int):
        """Groups of the queries that ask the cell, at like distances from its pivot, with these distances."""
        who = np.flatnonzero(self.asks[:, cell])
        if not len(who):
            return
        away = _to_pivots(self.vecs[who], self.pivots[[cell]])[:, 0]
        order = np.argsort(away, kind="stable")
        for s in range(0, len(order), _SLAB):
            part = order[s:s + _SLAB]
            yield who[part], away[part]


class _NearestRows(_Asking):
    """The k nearest rows so far of each query of a block: a row is looked at only where
    its distance is within the reach, or the k-th distance once k rows are known."""

    def __init__(self, block: dict, pivots: np.ndarray, k: int, only_earlier: bool, counter: Accumulator | None):
        super().__init__(block, pivots)
        self.k, self.only_earlier, self.counter = k, only_earlier, counter
        self.norm = (self.vecs * self.vecs).sum(1)
        # more than the rounding by which neighbours are ranked, and that of the products
        self.slack = 2 * 10.0**-RANK_DECIMALS + 1e-11 * (self.norm + float((pivots * pivots).sum(1).max()))
        self.far = self.reach**2 + self.slack
        self.wide = np.hstack([self.vecs, np.ones((len(self.ids), 1))])
        self.near = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))   # query row, corpus id, distance
        self.more = []

    def _merge(self):
        who, ids, d = (np.concatenate(x) for x in zip(self.near, *self.more))
        order = np.lexsort((ids, np.round(d, RANK_DECIMALS), who))
        who, ids, d = who[order], ids[order], d[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < self.k
        full = who[nth == self.k - 1]
        self.far[full] = np.fmin(self.far[full], d[nth == self.k - 1] + self.slack[full])
        self.near, self.more = (who[keep], ids[keep], d[keep]), []

    def meet(self, c: _CorpusBlock):
        wide = np.hstack([c.vecs, -0.5 * (c.vecs * c.vecs).sum(1)[:, None]])   # half of |q|^2 - distance, by one product
        pending = 0
        for cell, start, end in c.of_cells():
            for at, away in self.slabs(cell):
                a, b = _rows_in_reach(away, np.sqrt(self.far[at]) + _slack(self.vecs[at], self.pivots[[cell]]), c.ring[start:end])
                for lo in range(start + a, start + b, CHUNK_ROWS):
                    hi = min(start + b, lo + CHUNK_ROWS)
                    close = self.wide[at] @ wide[lo:hi].T
                    if self.counter is not None:
                        self.counter.add(close.size)
                    if self.only_earlier:
                        close[c.ids[lo:hi][None, :] >= self.ids[at][:, None]] = np.nan
                    hit = close >= (0.5 * (self.norm[at] - self.far[at]))[:, None]
                    if hi - lo > self.k and np.count_nonzero(hit) > 4 * self.k * len(at):
                        kth = np.partition(-close, self.k - 1, axis=1)[:, self.k - 1]
                        self.far[at] = np.fmin(self.far[at], self.norm[at] + 2 * kth + self.slack[at])
                        hit = close >= (0.5 * (self.norm[at] - self.far[at]))[:, None]
                    i, j = np.nonzero(hit)
                    if len(i):
                        self.more.append((at[i], c.ids[lo + j], np.maximum(self.norm[at[i]] - 2 * close[i, j], 0.0)))
                        pending += len(i)
                        if pending > _PENDING:
                            self._merge()
                            pending = 0
        if self.more:
            self._merge()

    def rest(self):
        who, ids, d = self.near
        return self.ids[who], ids, d


def _home_sizes(asked: DataFrame) -> dict[int, int]:
    return {r.home: r.n for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per cell


def search_cells(q: DataFrame, placed: DataFrame, cells: Cells, wanted: int, only_earlier: bool = False,
                 counter: Accumulator | None = None) -> DataFrame:
    """(query_id, doc_id, dist) rows among which are the ``wanted`` nearest placed rows of
    each query (query_id, qv): its home cell first, then the cells in reach."""
    spark = q.sparkSession
    held, pivots = spark.sparkContext.broadcast(cells), spark.sparkContext.broadcast(cells.pivots)

    def homes(batches):
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS // 8):
                part = pdf.iloc[s:s + CHUNK_ROWS // 8]
                d = _to_pivots(_stack(part["qv"]), held.value.pivots)
                home = d.argmin(1)
                yield part.assign(reach=np.inf, home=home.astype(np.int32), asks=_bits(np.arange(d.shape[1])[None, :] == home[:, None]))

    def asker(block):
        return _NearestRows(block, pivots.value, wanted, only_earlier, counter)

    schema = "query_id long, qv array<double>, reach double, home int, asks binary"
    at_home = cut_lineage(q.mapInPandas(homes, schema))
    sizes, corpus = _home_sizes(at_home), _corpus_blocks(placed, cells)
    first = cut_lineage(top_k(_meet(at_home, sizes, corpus, asker, OUT_SCHEMA), wanted, score="dist", ascending=True).drop("rank"))
    reach = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    reach = reach.select("query_id", F.when(F.col("n") >= wanted, F.sqrt("far")).otherwise(float("inf")).alias("found"))

    def others(batches):
        cells_ = held.value
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS // 8):
                part = pdf.iloc[s:s + CHUNK_ROWS // 8]
                home, x = part["home"].to_numpy(np.int64), _stack(part["qv"])
                bound = cells_.bounds(_to_pivots(x, cells_.pivots), home)
                ask = bound <= (np.sqrt(part["reach"].to_numpy(float)**2 + 2 * 10.0**-RANK_DECIMALS) + _slack(x, cells_.pivots))[:, None]
                ask[np.arange(len(part)), home] = False
                yield part.assign(asks=_bits(ask))[ask.any(1)]

    abroad = (at_home.drop("reach", "asks").join(reach, "query_id", "left")
              .select("query_id", "qv", F.coalesce("found", F.lit(float("inf"))).alias("reach"), "home").mapInPandas(others, schema))
    return first.unionByName(_meet(abroad, sizes, corpus, asker, OUT_SCHEMA))


def pivot_knn(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "query_id", qvec: str = "vec", cid: str = "doc_id",
              cvec: str = "vec", only_earlier: bool = False, exclude_self: bool = False, cell_rows: int = CELL_ROWS,
              counter: Accumulator | None = None) -> DataFrame:
    """(query_id, doc_id, dist, rank) of the k nearest corpus rows of every query by
    squared L2 distance; equal distances (9 decimals) go to the lower id. Rows without
    a vector have no neighbours and are nobody's. ``counter`` adds up compared pairs."""
    spark = queries.sparkSession
    wanted = k + 1 if exclude_self else k
    c = corpus.where(F.col(cvec).isNotNull()).select(F.col(cid).cast("long").alias("id"), F.col(cvec).cast("array<double>").alias("vec"))
    q = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).cast("long").alias("asker"), F.col(qvec).cast("array<double>").alias("qv"))
    if only_earlier:   # what is earlier depends on the asking row
        who, q = None, q.withColumnRenamed("asker", "query_id")
    else:
        keyed = q.select("asker", "qv", *_digest("qv"))
        once = cut_lineage(keyed.groupBy("h1", "h2").agg(F.min("asker").alias("query_id"), F.first("qv").alias("qv")))
        who, q = (keyed, once), once.select("query_id", "qv")
    placed, cells = into_cells(cut_lineage(lowest_copies(c, wanted)), cell_rows)
    if not len(cells.pivots):
        return spark.createDataFrame([], OUT_SCHEMA + ", rank int")
    found = search_cells(q, placed, cells, wanted, only_earlier, counter)
    if who is None:
        return top_k(found, k, score="dist", ascending=True)
    best = cut_lineage(top_k(found, wanted, score="dist", ascending=True).drop("rank"))
    keyed, once = who
    lists = cut_lineage(best.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "dist")).alias("near"))   # `wanted` rows each
                        .join(once.select("query_id", "h1", "h2"), "query_id").drop("query_id"))
    pairs = (keyed.select(F.col("asker").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
             .select("query_id", F.inline("near")))
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col("doc_id"))
    return top_k(pairs, k, score="dist", ascending=True)


def earlier_neighbours(asking: DataFrame, placed: DataFrame, cells: Cells, t: float, most: int,
                       counter: Accumulator | None = None) -> DataFrame:
    """(query_id, doc_id): for each row of ``asking`` (id, vec unit, after long) the first
    ``most`` rows of ``placed`` (unit vectors in cells) by id with after < id < its own
    id and a cosine of at least t."""
    spark = asking.sparkSession
    reach = math.sqrt(max(2 - 2 * t, 0.0))
    held, pivots = spark.sparkContext.broadcast(cells), spark.sparkContext.broadcast(cells.pivots)

    def routes(batches):
        c = held.value
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS // 8):
                part = pdf.iloc[s:s + CHUNK_ROWS // 8]
                d = _to_pivots(_stack(part["vec"]), c.pivots)
                home = d.argmin(1)
                ask = c.bounds(d, home) <= reach + SLACK
                yield pd.DataFrame({"query_id": part["id"], "qv": part["vec"], "after": part["after"], "reach": reach,
                                    "home": home.astype(np.int32), "asks": _bits(ask)})[ask.any(1)]

    class Earlier(_Asking):
        def meet(self, c: _CorpusBlock):
            out = []
            for cell, start, end in c.of_cells():
                ids, cm = c.ids[start:end], c.vecs[start:end]
                for at_, away in self.slabs(cell):
                    a, b = _rows_in_reach(away, self.reach[at_] + SLACK, c.ring[start:end])
                    by_id = a + np.argsort(ids[a:b], kind="stable")
                    qi, after, qm = self.ids[at_], self.after[at_], self.vecs[at_]
                    seen = np.zeros(len(at_), np.int64)
                    for lo in range(0, len(by_id), CHUNK_ROWS // 4):
                        at = by_id[lo:lo + CHUNK_ROWS // 4]
                        open_rows = np.flatnonzero((seen < most) & (ids[at[0]] < qi) & (ids[at[-1]] > after))
                        if not len(open_rows):
                            continue
                        if counter is not None:
                            counter.add(len(open_rows) * len(at))
                        near = (qm[open_rows] @ cm[at].T >= t) & (ids[at][None, :] < qi[open_rows][:, None]) & (ids[at][None, :] > after[open_rows][:, None])
                        near &= np.cumsum(near, 1) + seen[open_rows][:, None] <= most
                        i, j = np.nonzero(near)
                        seen[open_rows] += near.sum(1)
                        out.append((qi[open_rows][i], ids[at][j]))
            return [np.concatenate(x) for x in zip(*out)] if out else None

        def rest(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

    schema = "query_id long, qv array<double>, after long, reach double, home int, asks binary"
    asked = cut_lineage(asking.select("id", "vec", "after").mapInPandas(routes, schema))
    found = _meet(asked, _home_sizes(asked), _corpus_blocks(placed, cells), lambda block: Earlier(block, pivots.value), "query_id long, doc_id long")
    w = Window.partitionBy("query_id").orderBy("doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
