"""Hybrid (sparse + dense) scoring and top-k.

Per query: BM25 scores divided by their maximum when it is positive; dense
candidates scored 1/(1+squared L2), divided by their maximum; weighted sum over
the full outer join of both candidate sets (missing side = 0); top-k by score,
ties to the lowest id. Every document outside both candidate sets scores
exactly 0, also where scored documents are negative, so a query with fewer than
k candidates above 0 is padded with the lowest ids that neither side scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import global_rank
from .topk import RANK_DECIMALS, top_k

# Fixed default weights of the two retrievers.
BM25_WEIGHT = 0.5
DENSE_WEIGHT = 0.5


def max_normalize(df: DataFrame, score: str, group: str = "query_id") -> DataFrame:
    """score / max(score) per group when that max is > 0 (partial aggregate +
    join, so a group holding a third of the rows is not sorted in one task)."""
    mx = df.groupBy(group).agg(F.max(score).alias("_mx"))
    return (df.join(mx, group)
            .withColumn(score, F.when(F.col("_mx") > 0, F.col(score) / F.col("_mx")).otherwise(F.col(score)))
            .drop("_mx"))


def dense_scores(neighbours: DataFrame) -> DataFrame:
    """(query_id, doc_id, dense) from k-NN rows with squared L2 ``dist``."""
    return neighbours.select("query_id", "doc_id", (1.0 / (1.0 + F.col("dist"))).alias("dense"))


def _pads(weak: DataFrame, taken: DataFrame, doc_ids: DataFrame, k: int,
          rescore: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(query_id, doc_id, score 0): for each weak query its k lowest ids (or all
    there are) that are neither in ``taken`` nor scored by BM25.

    The ids are ranked once in a written table; each round joins the queries that
    still lack ids to the next window of ranks, four times as wide as the ranks
    before it. A query reads on only while its windows are taken or scored, so it
    reads a few times as many ids as it has scored rows, and no id twice."""
    ids = cut_lineage(global_rank(doc_ids.select("doc_id"), ["doc_id"], out="at"))
    n, lo, hi = ids.count(), 0, 4 * k
    lacking = weak.select("query_id", F.lit(k).cast("long").alias("lack"))
    out = taken.select("query_id", "doc_id", F.lit(0.0).alias("score")).limit(0)
    while lo < n and not lacking.isEmpty():
        window = ids.where((F.col("at") >= lo) & (F.col("at") < hi))
        asked = cut_lineage(lacking.withColumn("at", F.explode(F.sequence(F.lit(lo), F.lit(min(hi, n) - 1)).cast("array<long>")))
                            .join(window, "at").select("query_id", "doc_id", "lack"))
        free = asked.join(taken.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        if rescore is not None:
            free = free.join(rescore(asked.drop("lack")).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        ranked = top_k(free.withColumn("score", F.lit(0.0)), k)
        found = cut_lineage(ranked.where("rank <= lack").select("query_id", "doc_id", "score"))
        out = out.unionByName(found)
        got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        lacking = cut_lineage(lacking.join(got, "query_id", "left").select("query_id", (F.col("lack") - F.coalesce("got", F.lit(0))).alias("lack"))
                              .where("lack > 0"))
        lo, hi = hi, 4 * hi
    return out


def hybrid_top_k(bm25: DataFrame | None, dense: DataFrame | None, queries: DataFrame,
                 doc_ids: DataFrame, k: int = 3, bm25_weight: float = BM25_WEIGHT,
                 dense_weight: float = DENSE_WEIGHT, dense_candidates: int | None = None,
                 rescore: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score). ``bm25``: (query_id, doc_id, bm25);
    ``dense``: (query_id, doc_id, dense); ``queries``: query_id; ``doc_ids``: doc_id.
    ``dense_candidates``: most dense rows per query (default 2k). ``rescore``: BM25
    rows of given (query_id, doc_id) pairs (default: a semi join against ``bm25``).

    Outside the dense candidates the hybrid order is the BM25 order, so only the
    dense candidates and the BM25 top (k + dense candidates) can reach the final
    top-k. The scores are scanned once for that top, whose first row is the
    query's maximum; the dense candidates are scored apart. The full score
    table is neither written nor shuffled."""
    dense_candidates = dense_candidates or 2 * k
    if rescore is None and bm25 is not None:
        def rescore(pairs):
            return bm25.join(pairs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    dn = None
    if dense is not None:
        dn = max_normalize(dense, "dense").select("query_id", "doc_id", (F.col("dense") * dense_weight).alias("s2"))
    bn = None
    if bm25 is not None:
        top = cut_lineage(top_k(bm25, k + (dense_candidates if dn is not None else 0), score="bm25"))
        mx = top.groupBy("query_id").agg(F.max("bm25").alias("_mx"))
        rows = top.select("query_id", "doc_id", "bm25")
        if dn is not None:
            rows = rows.unionByName(rescore(dn).select("query_id", "doc_id", "bm25")).dropDuplicates(["query_id", "doc_id"])
        bn = rows.join(mx, "query_id").select(
            "query_id", "doc_id", (F.when(F.col("_mx") > 0, F.col("bm25") / F.col("_mx"))
                                   .otherwise(F.col("bm25")) * bm25_weight).alias("s1"))
    if bn is not None and dn is not None:
        cand = (bn.join(dn, ["query_id", "doc_id"], "full")
                .select("query_id", "doc_id",
                        (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score")))
    elif bn is not None:
        cand = bn.withColumnRenamed("s1", "score")
    else:
        cand = dn.withColumnRenamed("s2", "score")
    cand = cut_lineage(cand)
    strong = (cand.where(F.round("score", RANK_DECIMALS) > 0).groupBy("query_id").count()
              .where(F.col("count") >= k).select("query_id"))
    weak = cut_lineage(queries.select("query_id").distinct().join(strong, "query_id", "left_anti"))
    if not weak.isEmpty():
        cand = cand.unionByName(_pads(weak, cand, doc_ids, k, rescore if bm25 is not None else None))
    return top_k(cand, k, score="score", id_col="doc_id").select("query_id", "rank", "doc_id", "score")


def hit_at_k(results: DataFrame, keywords: list[str], text_col: str = "text") -> DataFrame:
    """(query_id, hit): any retrieved text contains any keyword (case-insensitive)."""
    kws = F.array(*[F.lit(k.lower()) for k in keywords])
    any_kw = F.exists(kws, lambda k: F.lower(F.col(text_col)).contains(k))
    return results.groupBy("query_id").agg(F.bool_or(any_kw).alias("hit"))


def retrieval_checks(results: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, returned, distinct, exact_k, no_duplicates) per query."""
    return (results.groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("returned"), F.countDistinct(id_col).alias("distinct"))
            .withColumn("exact_k", F.col("returned") == k)
            .withColumn("no_duplicates", F.col("returned") == F.col("distinct")))
