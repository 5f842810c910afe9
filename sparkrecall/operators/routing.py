"""Semantic-cache routing: which queries are served from memory.

Sequential definition (arrival order = ``seq``): a query is a *hit* when its
most similar *stored earlier* query has cosine >= threshold; otherwise it is a
*miss* and is stored. Only stored queries serve later ones, so a decision
depends on all earlier decisions (greedy leader clustering).

Exact round-based fixpoint, no driver loop over rows:
  * Copies of a vector collapse to the first of them: whatever decides that one
    serves the later copies, so they are hits.
  * One similarity join (``pivots.earlier_neighbours``) gives every row its first
    few earlier neighbours at the threshold. A row with a stored neighbour is a hit
    (final); one whose neighbours are all hits, and that has no further ones, is
    stored (final). A round reads those short lists and the statuses, not vectors.
  * A row whose whole list turned out to be hits asks for the next few, of the
    rows that are not hits. So a dense cluster costs a few links a row (nearly all
    of its rows see its stored leader first), never a quadratic edge list.
Every round decides at least the earliest undecided row, so it terminates.

A final pass computes the reported fields: confidence = best cosine over the
stored earlier rows (reported for misses too), memory_id = that row's id, ids
numbered by storage order after the preloaded memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_normalize
from ..session import bucketed_table, cut_lineage
from .knn import QUERY_BROADCAST_ROWS, knn
from .ordering import global_rank
from .pivots import CELL_ROWS, earlier_neighbours, into_cells, lowest_copies
from .topk import RANK_DECIMALS

# Fixed value: default similarity threshold for serving from memory.
THRESHOLD = 0.55


def _units(df: DataFrame, seq: str, vec: str) -> DataFrame:
    return df.select(F.col(seq).cast("long").alias("seq"), l2_normalize(as_double(vec)).alias("u"))


#: Earlier neighbours that a row asks for at once.
MOST_LINKS = 8
#: Above this threshold rounding may part copies of one vector, so they are not collapsed.
COPIES_AGREE = 1 - 1e-9


def _nodes(units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows to be decided by their neighbours: id, vec; rows that are stored at once: seq)."""
    rows = units
    alone = units.select("seq").limit(0)
    if threshold > 0:   # a zero vector has cosine 0 with everything
        zero = F.forall("u", lambda x: x == 0)
        rows, alone = units.where(~zero), units.where(zero).select("seq")
    rows = rows.select(F.col("seq").alias("id"), F.col("u").alias("vec"))
    return (lowest_copies(rows, 1) if threshold <= COPIES_AGREE else rows), alone


def stored_set(queries: DataFrame, threshold: float = THRESHOLD, *, seq: str = "seq", vec: str = "vec",
               known: DataFrame | None = None, cell_rows: int = CELL_ROWS, most: int = MOST_LINKS,
               counter=None) -> tuple[DataFrame, DataFrame, int]:
    """(vectors: seq, u), (status: seq, status 'S' stored or 'M' served) of the
    queries, and the number of rounds. ``known`` (seq, sim): best cosine to a
    preloaded memory; at the threshold it decides a query at once.

    The vectors are written once, bucketed by seq; rounds write statuses and links alone."""
    units = bucketed_table(_units(queries, seq, vec), "seq", prefix="route_units")
    open_units = units
    if known is not None:
        open_units = units.join(known.where(F.col("sim") >= threshold).select("seq"), "seq", "left_anti")
    nodes, alone = _nodes(open_units, threshold)
    nodes = cut_lineage(nodes)
    placed, cells = into_cells(nodes, cell_rows)
    if not len(cells.pivots):
        return units, cut_lineage(units.select("seq").join(alone.withColumn("status", F.lit("S")), "seq", "left")
                                  .select("seq", F.coalesce("status", F.lit("M")).alias("status"))), 0

    links = cut_lineage(earlier_neighbours(nodes.withColumn("after", F.lit(-2**63)), placed, cells, threshold, most, counter))
    # asked: seq, last neighbour of its list and whether the list is full
    asked = cut_lineage(links.groupBy(F.col("query_id").alias("seq")).agg(F.max("doc_id").alias("last"), (F.count(F.lit(1)) >= most).alias("full")))
    status = nodes.select(F.col("id").alias("seq"), F.lit("U").alias("status"))
    rounds = 0
    while True:
        rounds += 1
        seen = (links.join(status.where(F.col("status") != "M").select(F.col("seq").alias("doc_id"), "status"), "doc_id")
                .groupBy(F.col("query_id").alias("seq")).agg(F.bool_or(F.col("status") == "S").alias("hit")))
        after = (status.join(seen, "seq", "left").join(asked.where("full").select("seq", "full"), "seq", "left")
                 .select("seq", F.when(F.col("status") != "U", F.col("status")).when(F.col("hit"), F.lit("M"))
                         .when(F.col("hit").isNotNull(), F.lit("U")).when(F.col("full"), F.lit("R")).otherwise(F.lit("S")).alias("status")))
        status = cut_lineage(after)
        left = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        if left.get("R"):   # their lists held hits alone: the next ones, of the rows that are no hits
            more = status.where(F.col("status") == "R").select("seq").join(asked.select("seq", "last"), "seq")
            asking = nodes.join(more, F.col("id") == F.col("seq")).select("id", "vec", F.col("last").alias("after"))
            rest = placed.join(status.where(F.col("status") != "M").select(F.col("seq").alias("id")), "id", "left_semi")
            found = cut_lineage(earlier_neighbours(asking, rest, cells, threshold, most, counter))
            now = found.groupBy(F.col("query_id").alias("seq")).agg(F.max("doc_id").alias("last"), (F.count(F.lit(1)) >= most).alias("full"))
            asked = cut_lineage(asked.join(more.select("seq"), "seq", "left_anti").unionByName(now))
            links = cut_lineage(links.join(more.select(F.col("seq").alias("query_id")), "query_id", "left_anti").unionByName(found))
            status = status.withColumn("status", F.when(F.col("status") == "R", F.lit("U")).otherwise(F.col("status")))
        elif not left.get("U"):
            break
    decided = status.unionByName(alone.withColumn("status", F.lit("S")))
    # what is no node is a later copy, or served by the preloaded memory
    return units, cut_lineage(units.select("seq").join(decided, "seq", "left")
                              .select("seq", F.coalesce("status", F.lit("M")).alias("status"))), rounds


def route_decisions(queries: DataFrame, threshold: float = THRESHOLD, *, seq: str = "seq", vec: str = "vec",
                    preloaded: DataFrame | None = None, mem_id: str = "id",
                    mem_vec: str = "query_embedding", broadcast_rows: int = QUERY_BROADCAST_ROWS,
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per query: seq, source ('memory'|'retrieval'), memory_id (best stored
    earlier row, null if none), confidence (its cosine, 0.0 if none),
    stored_id (id given to the query when it is stored, else null).

    The preloaded memory is scored once, not per round; the best of it and the best
    earlier query that is stored compete at the end (a tie goes to the memory)."""
    known, n_pre = None, 0
    if preloaded is not None:
        pre = preloaded.select(F.col(mem_id).cast("long").alias("id"), l2_normalize(as_double(mem_vec)).alias("u"))
        best = knn(_units(queries, seq, vec), pre, 1, metric="ip", qid="seq", qvec="u", cid="id", cvec="u", broadcast_rows=broadcast_rows)
        known = cut_lineage(best.select(F.col("query_id").alias("seq"), F.col("doc_id").alias("pre_id"), F.col("dist").alias("sim")))
        # new ids follow the largest preloaded id, which may be beyond the row count
        n_pre = (preloaded.agg(F.max(F.col(mem_id).cast("long"))).first()[0] or 0) + 1 if not preloaded.isEmpty() else 0
    units, status, _ = stored_set(queries, threshold, seq=seq, vec=vec, known=known, cell_rows=cell_rows)
    stored = status.filter(F.col("status") == "S").select("seq")
    new_ids = cut_lineage(global_rank(stored, ["seq"], out="_r").select("seq", (F.col("_r") + n_pre).alias("stored_id")))
    best = knn(units, units.join(stored, "seq"), 1, metric="ip", qid="seq", qvec="u", cid="seq", cvec="u", only_earlier=True,
               broadcast_rows=broadcast_rows)
    best = best.select(F.col("query_id").alias("seq"), F.col("doc_id").alias("best_seq"), F.col("dist").alias("new_sim"))
    out = (units.select("seq").join(best, "seq", "left")
           .join(new_ids.select(F.col("seq").alias("best_seq"), F.col("stored_id").alias("new_id")), "best_seq", "left")
           .join(new_ids, "seq", "left"))
    out = out.join(known, "seq", "left") if known is not None else out.withColumns(
        {"pre_id": F.lit(None).cast("long"), "sim": F.lit(None).cast("double")})
    from_pre = F.col("pre_id").isNotNull() & (F.col("new_id").isNull() | (F.round("sim", RANK_DECIMALS) >= F.round("new_sim", RANK_DECIMALS)))
    sim = F.when(from_pre, F.col("sim")).otherwise(F.col("new_sim"))
    return out.select(
        "seq",
        F.when(sim >= threshold, F.lit("memory")).otherwise(F.lit("retrieval")).alias("source"),
        F.when(from_pre, F.col("pre_id")).otherwise(F.col("new_id")).alias("memory_id"),
        F.coalesce(sim, F.lit(0.0)).alias("confidence"),
        "stored_id")
