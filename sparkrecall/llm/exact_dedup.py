"""Exact deduplication with a heavy-hitter split.

A third of all rows may be copies of one text, so frequent digests must not meet
in one reduce task. Misra-Gries counters of bounded size, one set per task, name
the candidates; one exact pass with partial aggregation verifies their counts and
winners, and those few rows are broadcast, which decides the copies of frequent
texts on the map side. All other digests go through an ordinary shuffle. Only
digests and ids move, never texts.

Texts are equal when they are identical after every run of ASCII white space
became one space (null counts as empty). Of equal texts the row with the smallest
doc_id stays; a null doc_id ranks last. Rows that agree in both doc_id and text
are repeated rows: exactly one of them stays. Empty tables give empty results;
other columns, whatever their names, pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import drop_losers, fresh, normalised, text_of
from sparkrecall.session import cut_lineage

#: Counters of one Misra-Gries summary; also the most digests ever broadcast.
COUNTERS = 256
_LAST = 2**63 - 1


def digest_column(docs: DataFrame, text: str = "text"):
    """SHA-256 (binary) of the normalised text."""
    return F.unhex(F.sha2(normalised(text_of(docs, text)).cast("binary"), 256))


def digest_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Written table (uid, doc_id, digest), one row per row of ``docs``."""
    return cut_lineage(docs.select(docs[doc_id].cast("long").alias("doc_id"), digest_column(docs, text).alias("digest"))
                       .withColumn("uid", F.monotonically_increasing_id()))


def misra_gries(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, n): at most ``counters`` candidates, among them every value that
    holds over 1 / (counters + 1) of all rows. Each task keeps at most
    ``counters`` counters; summaries are added up and cut by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for v, n in zip(*(x.to_pylist() for x in b.column(0).value_counts().flatten()), strict=True):
                if v in held:
                    held[v] += n
                    continue
                held[v] = n
                if len(held) > counters:
                    cut = min(held.values())
                    held = {k: c - cut for k, c in held.items() if c > cut}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                             names=["key", "n"])

    found = rows.select(F.col(key).alias("key")).mapInArrow(run, "key binary, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(counters)


def _winners(rows: DataFrame) -> DataFrame:
    rank = F.coalesce("doc_id", F.lit(_LAST))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("uid", rank).alias("keep_uid"),
                                      F.count(F.lit(1)).alias("group_size"))


def classify(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(uid, doc_id, digest, keep_id, group_size, kept) for each row of
    ``digest_rows``. ``rows`` is read several times, so it should be a written table."""
    spark = rows.sparkSession
    candidates = [r.key for r in misra_gries(rows, "digest", counters).where("n > 1").collect()]  # at most `counters`
    parts = []
    if candidates:
        asked = spark.createDataFrame([(bytes(c),) for c in candidates], "digest binary")
        verified = _winners(rows.join(F.broadcast(asked), "digest", "left_semi")).where("group_size > 1").collect()
        heavy = spark.createDataFrame([tuple(r) for r in verified],
                                      "digest binary, keep_id long, keep_uid long, group_size long")
        parts.append(rows.join(F.broadcast(heavy), "digest"))
        rows = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    winners = _winners(rows)
    parts.append(rows.join(winners, "digest"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("uid", "doc_id", "digest", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns as they were."""
    rows = digest_rows(docs, text, doc_id)
    digest, key = fresh(docs, "digest", "id")
    repeated = not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    losers = (classify(rows, counters).where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
              .select(F.col("doc_id").alias(key), F.col("digest").alias(digest)))
    keyed = docs.withColumns({key: docs[doc_id].cast("long"), digest: digest_column(docs, text)})
    return drop_losers(docs, keyed, losers.distinct() if repeated else losers, [key, digest], repeated)
