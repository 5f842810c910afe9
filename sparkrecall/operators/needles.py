"""Log metrics for a whole table of needles in one job (``telemetry.query_metrics`` is
the same for one needle).

The log is reduced to one row of partial metrics per distinct query text. A needle can
only be in texts that hold all its grams (runs of three characters, or the needle
itself where it is shorter); its rarest gram, by the number of texts that hold it, names
the candidates, whose texts are then compared. Partial metrics of the matches add up per
needle. So work follows the rarest grams' texts, never needles times rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage
from .telemetry import MEMORY, RETRIEVAL, safe_double

#: Characters of a gram, and grams that a task holds before it hands them on (and those of one text).
GRAM, GRAMS_HELD = 3, 1 << 17


def _grams(rows: DataFrame, key: str, text: str, sizes: list[int], shorter: bool = False) -> DataFrame:
    """(key, gram): the distinct runs of each size of a text (``shorter``: of the text's
    own length where that is less). One pass over a text, however long it is."""
    def run(batches):
        for batch in batches:
            keys, grams = [], []
            for of, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in sizes:
                    own = {t[i:i + k] for i in range(len(t) - k + 1)} or ({t} if shorter else ())
                    keys += [of] * len(own)
                    grams += own
                if len(grams) > GRAMS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(grams, pa.string())], names=[key, "gram"])
                    keys, grams = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(grams, pa.string())], names=[key, "gram"])

    return rows.select(F.col(key), F.col(text).alias("_of")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, gram string")


def _partial_metrics(log: DataFrame, order_col: str) -> DataFrame:
    """One row per distinct trimmed, lower-cased query text (blank ones left out)."""
    conf, lat, src = safe_double(F.col("confidence")), safe_double(F.col("latency")), F.lower(py_strip("source"))
    latest = F.struct(F.col(order_col).alias("at"), "timestamp", "source", conf.alias("confidence"), lat.alias("latency"),
                      "memory_size", "retrieval_count", "memory_count")
    return (log.withColumn("_text", F.lower(py_strip("query"))).where("_text != ''").groupBy("_text").agg(
        F.count(F.lit(1)).alias("matches"), F.sum(conf).alias("conf"), F.count(conf).alias("n_conf"), F.max(conf).alias("max_conf"),
        F.sum(lat).alias("lat"), F.count(lat).alias("n_lat"), F.min(lat).alias("min_lat"),
        F.count_if(src == MEMORY).alias("memory"), F.count_if(src == RETRIEVAL).alias("retrieval"),
        F.count_if(~src.isin(MEMORY, RETRIEVAL)).alias("other"), F.max_by(latest, F.col(order_col)).alias("latest")))


def query_metrics_table(log: DataFrame, needles: DataFrame, needle: str = "needle", order_col: str = "seq") -> DataFrame:
    """The row of ``query_metrics`` for each distinct needle that some query contains
    (both trimmed and lower-cased); blank needles match nothing."""
    asked = needles.select(F.col(needle).cast("string").alias("query")).distinct()
    asked = cut_lineage(asked.withColumn("_needle", F.lower(py_strip("query"))).where("_needle != ''"))
    texts = cut_lineage(_partial_metrics(log, order_col).withColumn("_id", F.monotonically_increasing_id()))
    sizes = [r[0] for r in asked.select(F.least(F.char_length("_needle"), F.lit(GRAM))).distinct().collect()]   # three at most
    postings = _grams(texts, "_id", "_text", sorted(sizes))
    known = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    own = cut_lineage(_grams(asked.select("_needle").distinct(), "_needle", "_needle", [GRAM], shorter=True))
    own = own.join(own.groupBy("_needle").agg(F.count(F.lit(1)).alias("all")), "_needle")
    rarest = (own.join(known, "gram")
              .groupBy("_needle", "all").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "gram")).alias("best"))
              .where("found = all").select("_needle", F.col("best.gram").alias("gram")))   # a gram that no text has: no match
    candidates = cut_lineage(rarest).join(postings, "gram").select("_needle", "_id")
    matched = candidates.join(texts, "_id").where(F.contains("_text", "_needle"))
    total = matched.groupBy("_needle").agg(
        F.sum("matches").alias("matches"), (F.sum("conf") / F.sum("n_conf")).alias("avg_confidence"), F.max("max_conf").alias("max_confidence"),
        (F.sum("lat") / F.sum("n_lat")).alias("avg_latency"), F.min("min_lat").alias("min_latency"), F.sum("memory").alias("memory"),
        F.sum("retrieval").alias("retrieval"), F.sum("other").alias("other"), F.max_by("latest", F.col("latest.at")).alias("latest"))
    fields = ("timestamp", "source", "confidence", "latency", "memory_size", "retrieval_count", "memory_count")
    return asked.join(total, "_needle").select(
        "query", "matches", "avg_confidence", "max_confidence", "avg_latency", "min_latency", "memory", "retrieval", "other",
        *[F.col(f"latest.{f}").alias(f"latest_{f}") for f in fields])
