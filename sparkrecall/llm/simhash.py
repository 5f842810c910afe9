"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit i is set where over half of the text's shingle hashes
have it set. Equal fingerprints are one node. To link nodes at 2 or fewer differing
bits, a fingerprint is split into segments of 22, 21 and 21 bits. Two errors leave
one of three segments exact, and the next segment has two errors at most, so the
Golay keys of that next segment (one to six codeword indices, see ``golay``) meet.
A key is (exact segment, codeword index of the next), 34 bits: up to 18 per
fingerprint. Fingerprints that share a key and differ in 2 bits or fewer are linked.

Keys held by at most ``BUCKET`` fingerprints are compared within the bucket. The
fingerprints of larger buckets are linked exactly, without comparing them: each goes to
itself and its 64 one-bit neighbours, and those that meet at such a place (65 at
most, all within 2 bits of each other) are linked to the least of them. Every pair
within 2 bits meets at the word between, so no link is lost.

Words are runs of anything but ASCII white space, A-Z lower-cased; a null or empty
text has no word and fingerprint zero, linked like any other. Repeated rows have the
same fingerprint. component_id is the smallest doc_id of the component (null only where
all its ids are null). An empty table gives an empty result; other columns, whatever
their names, pass through ``near_dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import drop_losers, fresh, text_of, text_slices
from sparkrecall.llm.components import components
from sparkrecall.llm.golay import codeword_indices
from sparkrecall.session import cut_lineage

SHINGLE, SEED = 3, 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 2
#: Fingerprints compared within one key; larger buckets are linked by one-bit neighbours.
BUCKET = 64
_LAST = 2**63 - 1


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """XXH64 of each shingle, big-endian, one after another."""
    from xxhash import xxh64_digest
    words = text.lower().split()
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(line, seed)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begin = [0, *(spaces[:len(words) - shingle] + 1).tolist()]
    end = [*spaces[shingle - 1:].tolist(), len(line)]
    return b"".join([xxh64_digest(line[a:b], seed) for a, b in zip(begin, end, strict=True)])


#: For each byte, its bits as eight counters of 8 bits.
_LANES = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.uint8).view(np.uint64)[:, 0]


def majority(hashes: list[bytes]) -> np.ndarray:
    """The fingerprint of each text from its shingle hashes."""
    n = np.array([len(h) // 8 for h in hashes], np.int64)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    begin = np.cumsum(n) - n
    # counters of 8 bits hold 255 rows; blocks of so many are summed first
    blocks = np.concatenate([np.arange(b, b + k, 255) for b, k in zip(begin[full], n[full], strict=True)])
    per_block = np.add.reduceat(_LANES[raw], blocks, axis=0).view(np.uint8).astype(np.int64)
    counts = np.add.reduceat(per_block, np.searchsorted(blocks, begin[full]), axis=0)
    bits = counts * 2 > n[full][:, None]
    out[full] = np.packbits(bits, axis=1).view(">u8")[:, 0]
    return out


def fingerprint_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                     seed: int = SEED) -> DataFrame:
    """Written table (doc_id, text_hash, fp), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                fp = majority([shingle_hashes(t, shingle, seed) for t in texts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("text_hash"),
                       docs[text].alias("text"))
    return cut_lineage(rows.mapInArrow(run, "doc_id long, text_hash long, fp long"))


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): up to 18 keys for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                fp = batch.column(0)[a:a + 4096].to_numpy(zero_copy_only=False)
                u = fp.view(np.uint64)
                parts = [((u >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
                keys, owners = [], []
                for i, exact in enumerate(parts):
                    index = codeword_indices(parts[(i + 1) % len(parts)])
                    at, _ = np.nonzero(index >= 0)
                    keys.append((i << 34) + (exact[at] << 12) + index[index >= 0])
                    owners.append(fp[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def neighbour_places(fps: DataFrame) -> DataFrame:
    """(place, fp): each fingerprint at itself and its 64 one-bit neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            for a in range(0, len(batch), 4096):
                fp = batch.column(0)[a:a + 4096].to_numpy(zero_copy_only=False)
                places = (fp.view(np.uint64)[:, None] ^ masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), pa.array(np.repeat(fp, 65))], names=["place", "fp"])

    return fps.select("fp").mapInArrow(run, "place long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within 2 bits of each
    other; ``fps`` should be a written table."""
    keys = golay_keys(fps)
    shared = cut_lineage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small, large = shared.where(F.col("n") <= bucket), shared.where(F.col("n") > bucket)
    groups = keys.join(small.select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (groups.select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS))
    if large.isEmpty():
        return pairs
    crowded = keys.join(large.select("key"), "key").select("fp").distinct()
    meeting = neighbour_places(crowded).groupBy("place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = meeting.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b")
    return pairs.unionByName(stars)


def classes(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Written table (fp, component_id, keep_hash): for each distinct fingerprint
    its component's smallest doc_id, and the text hash of one row with that id."""
    rank = F.coalesce("doc_id", F.lit(_LAST))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min(rank).alias("least"), F.min_by("text_hash", rank).alias("hash")))
    roots = cut_lineage(components(links(fps, bucket)))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("id"), F.min_by("hash", "least").alias("keep_hash"))
    return cut_lineage(rooted.join(kept, "root").select(
        "fp", F.when(F.col("id") != _LAST, F.col("id")).alias("component_id"), "keep_hash"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``."""
    rows = fingerprint_rows(docs, text, doc_id)
    return rows.join(classes(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that with its smallest doc_id."""
    rows = fingerprint_rows(docs, text, doc_id)
    repeated = not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    key, hashed = fresh(docs, "id", "text_hash")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash"))
    losers = rows.join(classes(rows), "fp").where(~stays).select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed))
    keyed = docs.withColumns({key: docs[doc_id].cast("long"), hashed: F.xxhash64(text_of(docs, text))})
    return drop_losers(docs, keyed, losers.distinct() if repeated else losers, [key, hashed], repeated)
