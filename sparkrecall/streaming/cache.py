"""Streaming semantic cache: every micro-batch is routed against the memory
written by all earlier micro-batches, with the same exact fixpoint as the batch
operator, so a stream (in arrival order) gives the same decisions as one batch.

State lives in tables, not in one group: ``<state>/memory`` holds the stored
entries (vectors) partitioned by batch id, ``<out>`` the decisions, also by
batch id. A retried micro-batch reads only memory of earlier batches and
overwrites its own partitions, so re-execution after an executor or driver
failure is idempotent (exactly-once output with the stream checkpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import THRESHOLD, route_decisions
from ..session import cut_lineage


def _read_or_none(spark, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def route_micro_batch(batch: DataFrame, batch_id: int, state_path: str, out_path: str,
                      threshold: float = THRESHOLD, seq: str = "seq", vec: str = "vec", answer: str | None = None) -> None:
    """``answer``: a column with the answer to store for a miss; the output then has
    ``served``, a hit's stored answer or a miss's own."""
    spark = batch.sparkSession
    mem_path = f"{state_path.rstrip('/')}/memory"
    mem = _read_or_none(spark, mem_path, "id long, query_embedding array<double>, answer string, batch_id long")
    if mem is not None:
        mem = mem.filter(F.col("batch_id") < batch_id)
        if mem.isEmpty():
            mem = None
    q = batch.select(F.col(seq).alias("seq"), F.col(vec).alias("vec"),
                     (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))
    dec = route_decisions(q, threshold, seq="seq", vec="vec", preloaded=mem, mem_id="id",
                          mem_vec="query_embedding")
    if answer:
        dec = cut_lineage(dec)
        own = dec.join(q.select("seq", "answer"), "seq")
        stored = own.filter("stored_id is not null").select(F.col("stored_id").alias("memory_id"), F.col("answer").alias("past"))
        if mem is not None:
            stored = stored.unionByName(mem.select(F.col("id").alias("memory_id"), F.col("answer").alias("past")))
        served = F.when(F.col("source") == "memory", F.col("past")).otherwise(F.col("answer"))
        dec = own.join(stored, "memory_id", "left").withColumn("served", served).select(*dec.columns, "served")
    dec = dec.withColumn("batch_id", F.lit(batch_id).cast("long"))
    (dec.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
     .parquet(out_path))
    stored = (spark.read.parquet(out_path).filter(F.col("batch_id") == batch_id)
              .filter(F.col("stored_id").isNotNull()).select("seq", "stored_id"))
    new_mem = (stored.join(q, "seq")
               .select(F.col("stored_id").alias("id"), F.col("vec").cast("array<double>").alias("query_embedding"), "answer")
               .withColumn("batch_id", F.lit(batch_id).cast("long")))
    (new_mem.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
     .parquet(mem_path))


def streaming_semantic_cache(stream: DataFrame, state_path: str, out_path: str, checkpoint: str,
                             threshold: float = THRESHOLD, seq: str = "seq", vec: str = "vec",
                             available_now: bool = True, answer: str | None = None) -> StreamingQuery:
    """Start the cache over a streaming DataFrame of (seq, vec [, answer]) rows."""
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: route_micro_batch(df, bid, state_path, out_path, threshold, seq, vec, answer)))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
