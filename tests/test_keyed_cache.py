"""The keyed stream decides each key's rows as the batch routing does, across restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.streaming import keyed_cache
from test_routing import sequential


def rows_of(spark, folder):
    return {(r.key, r.seq): r for r in spark.read.parquet(folder).collect()}


def test_keys_run_apart_and_go_on_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_cache, "BLOCK", 5)
    rnd = np.random.default_rng(3)
    data = [(str(i % 3) if i % 7 else None, i, [float(v) for v in rnd.normal(size=4)] if i % 11 else [0.0] * 4) for i in range(120)]
    data += [("0", 500, None)]
    schema = "key string, seq long, vec array<double>"
    for k in range(3):     # a query of its own per third: each restart reads the state of the one before
        part = spark.createDataFrame(data[k * 41:(k + 1) * 41], schema)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        keyed_cache.streaming_keyed_cache(stream, "key", f"{tmp_path}/out", f"{tmp_path}/ckpt", 0.6).awaitTermination()
    got = rows_of(spark, f"{tmp_path}/out")
    assert len(got) == 120
    for key in ("0", "1", "2", None):
        mine = [(i, v) for k, i, v in data if k == key and v is not None]
        for (i, _), want in zip(mine, sequential([v for _, v in mine], 0.6), strict=True):
            r = got[key, i]
            assert (r.source, r.memory_id, r.stored_id) == (want[0], want[1], want[3])
            assert r.confidence == pytest.approx(want[2], abs=1e-9)
    assert any(r.source == "memory" for r in got.values())


def test_entries_expire(spark, tmp_path):
    import time
    schema = "key string, seq long, vec array<double>"
    for k in range(2):
        spark.createDataFrame([("a", k, [1.0, 0.0])], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = keyed_cache.streaming_keyed_cache(stream, "key", f"{tmp_path}/out", f"{tmp_path}/ckpt", 0.5, ttl_ms=1000)
        for _ in range(60):
            time.sleep(0.5)
            if query.recentProgress and sum(p.numInputRows for p in query.recentProgress):
                break
        query.stop()
        time.sleep(1.2)
    got = rows_of(spark, f"{tmp_path}/out")
    assert [got["a", k].source for k in (0, 1)] == ["retrieval", "retrieval"]
    assert got["a", 1].stored_id == 1      # ids are not used again
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("memory_id").isNotNull()).count() == 0
