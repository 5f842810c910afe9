"""Per-group top-k. ``row_number() <= k`` lets Catalyst insert a partial
WindowGroupLimit before the shuffle, so every map task forwards at most k rows
per group: a query matching a third of the corpus still sorts only k rows per
map partition on the reduce side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores are ranked after rounding to this many decimals so that mathematically
# equal scores summed in a different order tie exactly (then lowest id wins).
RANK_DECIMALS = 9


def top_k(scores: DataFrame, k: int, group: str = "query_id", score: str = "score",
          id_col: str = "doc_id", rank_col: str = "rank", ascending: bool = False) -> DataFrame:
    key = F.round(F.col(score), RANK_DECIMALS)
    w = Window.partitionBy(group).orderBy(key.asc() if ascending else key.desc(), F.col(id_col).asc())
    return scores.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
