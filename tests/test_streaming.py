"""The streaming cache over micro-batches equals batch routing; the streaming
counters equal a batch aggregation."""

from pyspark.sql import functions as F

from sparkrecall.plans.queries import (events_log, routing_embeddings, stream_log_counters_events,
                                       stream_routing_embeddings)

SF = "/root/testdata/sf0.001"


def test_stream_routing_equals_batch(spark):
    a = {tuple(r) for r in routing_embeddings(spark, SF).collect()}
    b = {tuple(r) for r in stream_routing_embeddings(spark, SF).select(
        "vec_id", "source", "memory_id", "confidence", "stored_id").collect()}
    assert a == b and len(a) == 500
    assert sum(1 for r in a if r[1] == "memory") == 154


def test_stream_counters_equal_batch(spark):
    got = {(r["run_id"], r["source"]): r["n"] for r in stream_log_counters_events(spark, SF).collect()}
    want = {(r["run_id"], r["source"]): r["n"] for r in
            events_log(spark, SF).groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_stream_serves_stored_answers(spark, tmp_path):
    """A hit gets the answer stored by an earlier micro-batch, or by its own."""
    from sparkrecall.streaming.cache import streaming_semantic_cache
    schema = "seq long, vec array<double>, answer string"
    batches = [[(1, [1.0, 0.0], "first"), (2, [1.0, 0.01], "unused")], [(3, [0.0, 1.0], "third"), (4, [1.0, 0.0], "unused"), (5, [0.0, 1.0], "no")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        streaming_semantic_cache(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/out",
                                 f"{tmp_path}/ckpt", 0.9, answer="answer").awaitTermination()
    got = {r["seq"]: (r["source"], r["memory_id"], r["served"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("retrieval", None, "first"), 2: ("memory", 0, "first"), 3: ("retrieval", 0, "third"), 4: ("memory", 0, "first"),
                   5: ("memory", 1, "third")}
