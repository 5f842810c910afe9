"""Semantic cache with one state per cache key (tenant, conversation, topic): an entry
serves only later queries of its own key, so keys run side by side.

``transformWithStateInPandas`` keeps a key's stored vectors as a list of blocks of at
most ``BLOCK`` entries, and its next entry id. A micro-batch's rows of a key are taken
in order of ``seq``; the stored blocks stream past them one at a time, so a key's
memory in the task is its rows of the micro-batch and one block, however many entries
the key holds. State lives in the checkpoint (RocksDB changelog), so a restarted query
goes on where it was. With ``ttl_ms`` blocks expire that long after they were stored;
Spark then looks for expired state in batches without new rows too, so such a query
runs until it is stopped.

All rows of a key of a micro-batch are decided in one task, for each decision depends
on those before it; a stream that has one key for everything should use
``streaming_semantic_cache``, whose state is a table and whose lookups are joins.

Decisions and ids are those of ``route_decisions`` on each key's rows alone. Rows with
a null vector are left out; a null key is a key; a zero vector is similar to nothing.
Rows must arrive in order of ``seq`` from one micro-batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import as_double, l2_normalize
from ..operators.routing import THRESHOLD
from ..operators.topk import RANK_DECIMALS

#: Entries of one state block.
BLOCK = 1024
#: Fixed value: the state store that keeps lists.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = "key string, seq long, source string, memory_id long, confidence double, stored_id long"


class _Best:
    """Best similarity and its entry id per row; a tie goes to the lower id."""

    def __init__(self, rows: int):
        self.sim, self.id = np.full(rows, -np.inf), np.full(rows, -1, np.int64)

    def offer(self, at: slice | np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Similarities (rows x entries) of entries in id order, all later than those seen."""
        ranked = np.round(sims, RANK_DECIMALS)
        top = ranked.argmax(1)
        better = np.take_along_axis(ranked, top[:, None], 1)[:, 0] > np.round(self.sim[at], RANK_DECIMALS)
        rows = np.arange(len(self.sim))[at][better]
        self.sim[rows] = sims[np.flatnonzero(better), top[better]]
        self.id[rows] = ids[top[better]]


def _or_null(ids: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(ids.copy(), ids < 0)


class CacheProcessor(StatefulProcessor):
    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getListState("blocks", "first long, n int, vectors binary", self.ttl_ms)
        self.next_id = handle.getValueState("next_id", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        u = np.vstack(batch["u"].to_numpy())
        best = _Best(len(u))
        for first, n, raw in self.blocks.get():
            stored = np.frombuffer(raw).reshape(n, -1)
            best.offer(slice(None), u @ stored.T, np.arange(first, first + n))
        start = following = self.next_id.get()[0] if self.next_id.exists() else 0
        ids = np.full(len(u), -1, np.int64)
        new = np.zeros_like(u)
        for i in range(len(u)):
            held = following - start
            if held:
                best.offer(np.array([i]), (new[:held] @ u[i])[None, :], np.arange(start, following))
            if not best.sim[i] >= self.threshold:
                new[held], ids[i], following = u[i], following, following + 1
        for a in range(start, following, BLOCK):
            b = min(a + BLOCK, following)
            self.blocks.appendValue((a, b - a, np.ascontiguousarray(new[a - start:b - start]).tobytes()))
        self.next_id.update((following,))
        hit, known = best.sim >= self.threshold, best.id >= 0
        yield pd.DataFrame({
            "key": key[0], "seq": batch["seq"].to_numpy(), "source": np.where(hit, "memory", "retrieval"),
            "memory_id": _or_null(best.id), "confidence": np.where(known, best.sim, 0.0), "stored_id": _or_null(ids)})

    def close(self) -> None:
        pass


def streaming_keyed_cache(stream: DataFrame, key: str, out_path: str, checkpoint: str, threshold: float = THRESHOLD,
                          seq: str = "seq", vec: str = "vec", ttl_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the cache over a stream of (key, seq, vec) rows; decisions (key as string,
    seq, source, memory_id, confidence, stored_id) go to Parquet files in ``out_path``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where(F.col(vec).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"),
                                                       l2_normalize(as_double(vec)).alias("u"))
    decided = rows.groupBy("key").transformWithStateInPandas(
        CacheProcessor(threshold, ttl_ms), _OUT, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")
    w = decided.writeStream.format("parquet").outputMode("append").option("path", out_path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now and ttl_ms is None else w.trigger(processingTime="1 second")).start()
