"""Token ids as flat binary files that can be memory-mapped.

A folder holds, per shard, ``<shard>.bin`` (the ids of its documents one after
another, little-endian uint16 where the vocabulary fits, else uint32),
``<shard>.off`` (int64: where each document begins in the shard, and the shard's
end) and ``<shard>.doc`` (int64 document ids); ``manifest.json`` names the shards
in order with their counts and bases. Shards follow ascending doc_id, and so do the
documents in each, so the files are one stream (rows that share an id, or have none,
may span shards, in the order of their text's hash); a shard's base is the prefix sum of
the shards before it. Each shard is written by one task under a temporary name and
renamed, so that a task run again leaves the same file.

Documents with null text are empty (they have the end id only). A null doc_id sorts
first and is written as the least int64. Repeated rows are all written, one after
another. An empty table gives a manifest without shards. Other columns are not read.
The folder must be on storage that all executors share.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import text_slices
from sparkrecall.llm.token_ids import encoder, id_type
from sparkrecall.session import ensure_checkpoint_dir

_NULL = -(2**63)
_COUNTS = "shard int, n_docs long, n_tokens long"


def storage(uri: str):
    """pyarrow file system and path of a folder given as a path or URI."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _replace(disk, old: str, new: str) -> None:
    from pyarrow import fs
    if not isinstance(disk, fs.LocalFileSystem) and disk.get_file_info(new).type != fs.FileType.NotFound:
        disk.delete_file(new)
    disk.move(old, new)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_word: bool = True, text: str = "text",
                      doc_id: str = "doc_id", shards: int | None = None) -> dict:
    """Encodes all texts into ``folder``; returns the manifest. ``shards`` is the
    number of files (default: Spark's number of shuffle partitions)."""
    dtype = id_type(tokenizer)
    disk, path = storage(folder)
    disk.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        me, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out = None
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                if out is None:
                    disk, path = storage(folder)
                    base = f"{path}/{me:06d}"
                    temp = f"{path}/_{me:06d}-{attempt}-{uuid.uuid4().hex}"
                    out = {x: disk.open_output_stream(f"{temp}.{x}") for x in ("bin", "off", "doc")}
                    n_docs = n_tokens = 0
                    enc = encoder(tokenizer, by_word)
                for ids in enc.with_end(texts, end_id):
                    out["bin"].write(ids.astype(dtype).tobytes())
                    out["off"].write(np.array([n_tokens], "<i8").tobytes())
                    n_tokens += len(ids)
                out["doc"].write(np.array(part.column(0).fill_null(_NULL).to_pylist(), "<i8").tobytes())
                n_docs += len(texts)
        if out is not None:
            out["off"].write(np.array([n_tokens], "<i8").tobytes())
            for x, f in out.items():
                f.close()
                _replace(disk, f"{temp}.{x}", f"{base}.{x}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([me], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    # the text's hash deals the rows of one id (or of none) over many shards; it and the text
    # break ties, so that a task run again writes the same file
    ranged = rows.repartitionByRange(*([shards] if shards else []), "doc_id", "text_hash")
    counts = ranged.sortWithinPartitions("doc_id", "text_hash", "text").mapInArrow(run, _COUNTS).collect()  # one row per shard
    listed, docs_before, tokens_before = [], 0, 0
    for c in sorted(counts):
        listed.append({"shard": f"{c.shard:06d}", "n_docs": c.n_docs, "n_tokens": c.n_tokens, "first_doc": docs_before,
                       "first_token": tokens_before})
        docs_before, tokens_before = docs_before + c.n_docs, tokens_before + c.n_tokens
    manifest = {"folder": folder, "dtype": dtype, "n_docs": docs_before, "n_tokens": tokens_before, "shards": listed}
    with disk.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    disk, path = storage(folder)
    with disk.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """Memory-mapped view of one shard (read whole where files can't be mapped)."""

    def __init__(self, folder: str, shard: str, dtype: str):
        from pyarrow import fs
        disk, path = storage(folder)

        def load(x: str, kind: str):
            name = f"{path}/{shard}.{x}"
            if isinstance(disk, fs.LocalFileSystem):
                size = disk.get_file_info(name).size
                return np.memmap(name, kind, "r") if size else np.zeros(0, kind)
            with disk.open_input_stream(name) as f:
                return np.frombuffer(f.read(), kind)

        self.ids, self.offsets, self.docs = load("bin", dtype), load("off", "<i8"), load("doc", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens
    and the unsigned CRC-32 of its ids as little-endian uint32; with ``with_ids``
    also the ids."""
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    shards = [(s["shard"], s["first_token"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "shard string, base long").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(folder, name, dtype)
                step = 64 if with_ids else 4096
                for a in range(0, len(shard), step):
                    b = min(len(shard), a + step)
                    out = {"doc_id": pa.array([None if d == _NULL else d for d in shard.docs[a:b].tolist()], pa.int64()),
                           "start": pa.array(base + shard.offsets[a:b]), "n_tokens": pa.array(np.diff(shard.offsets[a:b + 1])),
                           "ids_crc32": pa.array([zlib.crc32(shard[i].astype("<u4").tobytes()) for i in range(a, b)], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([shard[i].astype("i8") for i in range(a, b)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return listed.mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = True, folder: str | None = None) -> DataFrame:
    """Writes the files (into the shared checkpoint folder if none is given) and reads them back."""
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, end_id, by_word)
    return read_token_files(spark, folder)
