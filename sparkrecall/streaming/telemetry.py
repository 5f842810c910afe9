"""Streaming telemetry: an append-only log sink and running per-run,
per-source counters (bounded keys, so no watermark is needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_log_sink(log: DataFrame, path: str, checkpoint: str, run_col: str = "run_id",
                    available_now: bool = True) -> StreamingQuery:
    """Append log rows (blank queries dropped) to parquet partitioned by run."""
    w = (log.filter(F.trim(F.coalesce(F.col("query"), F.lit(""))) != "")
         .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy(run_col).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def log_counters(log: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per (run, source): rows, sums and averages of confidence and latency."""
    return log.groupBy(run_col, "source").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum("confidence").alias("sum_confidence"),
                                                F.sum("latency").alias("sum_latency"),
                                                F.avg("confidence").alias("avg_confidence"),
                                                F.avg("latency").alias("avg_latency"))


def stream_log_counters(log: DataFrame, out_path: str, checkpoint: str, run_col: str = "run_id",
                        available_now: bool = True) -> StreamingQuery:
    """Running counters in update mode: each micro-batch writes the totals of the runs
    it touched as its own version (a retried batch replaces its version), so a
    trigger's work follows its input and readers never meet a folder half written.
    ``read_log_counters`` gives the newest totals."""
    agg = log_counters(log, run_col)

    def write(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(out_path))

    w = agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_log_counters(spark: SparkSession, path: str, run_col: str = "run_id") -> DataFrame:
    """The newest totals per (run, source)."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (run_col, "source", "version")]
    newest = rows.groupBy(run_col, "source").agg(F.max_by(F.struct(*others), "version").alias("x"))
    return newest.select(run_col, "source", "x.*")
