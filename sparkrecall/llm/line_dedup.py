"""Line deduplication by a deletion-neighbourhood join.

Two lines are the same when their words are; lines of ``NEAR_WORDS`` words or more are
also taken together when one word's insertion, deletion or substitution makes one the
other (edit distance 1 over words). A line is dropped when an earlier one, by (doc_id,
line number), is the same or within that distance; the earliest stays.

The neighbourhood of a line is itself and each variant with one word deleted, as hashed
keys. A line and a shorter one meet where a variant equals the shorter line; two lines
of equal length meet where the same word is deleted from both. Per key, the least place
of each kind is enough to know whether an earlier neighbour exists, so keys are
aggregated, with partial aggregation, and no pairs within a key are made; each line's
least neighbours are then verified by their words.

Most lines have no neighbour, so variants are made only for lines that may: one edit
leaves the first or the last words of a line (some number below half of them) alone,
and lines go on only if that prefix or suffix also begins or ends another line.

The tables of shared keys grow with the corpus, so their joins are shuffled at every size.

Lines without a word are never dropped. A null or empty text has no such line. A null
doc_id ranks last; rows that share a doc_id are not deduplicated against each other,
repeated rows therefore neither. An empty table gives an empty result; other columns,
whatever their names, pass through ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import fresh, mix64, prefix_sums, text_of, text_slices
from sparkrecall.session import cut_lineage

#: Lines of fewer words are the same only if equal: one edit would leave under four fifths of the words.
NEAR_WORDS = 5
_LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def end_lengths(n: int) -> list[int]:
    """How many first and last words a line of n words is looked up by: for a partner
    of n or n + 1 words, and for one of n - 1."""
    half = [k for k in ((n - 1) // 2, (n - 2) // 2 if n > NEAR_WORDS else 0) if k]
    return sorted({k if k < 4 else 1 << (k.bit_length() - 1) for k in half})


def line_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Written table: a row for each line with a word: (rank, text_hash, line_no, again,
    d1, d2, ends). ``again``: it stands earlier in its text; ends: keys of its first
    and last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                owner, number, again, digests, ends = [], [], [], [], []
                for d, t in enumerate(texts):
                    seen: set[bytes] = set()
                    for i, line in enumerate(t.split(b"\n")):
                        words = line.split()
                        if not words:
                            continue
                        digest = xxh3_128_digest(b" ".join(words))
                        owner.append(d)
                        number.append(i)
                        again.append(digest in seen)
                        digests.append(digest)
                        keys = []
                        if len(words) >= NEAR_WORDS and digest not in seen:
                            for k in end_lengths(len(words)):
                                keys.append(xxh3_64_intdigest(b" ".join(words[:k]), 2 * k) - (1 << 63))
                                keys.append(xxh3_64_intdigest(b" ".join(words[-k:]), 2 * k + 1) - (1 << 63))
                        ends.append(keys)
                        seen.add(digest)
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "rank": part.column(0).take(take), "text_hash": part.column(1).take(take), "line_no": pa.array(number, pa.int32()),
                    "again": pa.array(again, pa.bool_()), "d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1]),
                    "ends": pa.array(ends, pa.list_(pa.int64()))})

    return cut_lineage(_keyed(docs, text, doc_id).mapInArrow(
        run, "rank long, text_hash long, line_no int, again boolean, d1 long, d2 long, ends array<long>"))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(text_of(docs, text)).alias("text_hash"),
                       docs[text].alias("text"))


def candidate_lines(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Written table (at, d1, d2, line): the distinct lines that may have a neighbour;
    ``at`` numbers them by their earliest place."""
    keys = rows.select("rank", "text_hash", "line_no", "d1", F.explode("ends").alias("key"))
    shared = cut_lineage(keys.groupBy("key").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo != hi").select("key"))
    asked = (keys.join(shared.hint("merge"), "key").groupBy("rank", "text_hash").agg(F.collect_set("line_no").alias("lines"))
             .toDF("r", "h", "lines"))
    keyed = _keyed(docs, text, doc_id)
    joined = keyed.join(asked, (keyed["rank"] == asked["r"]) & (keyed["text_hash"] == asked["h"])).select("rank", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                ranks, numbers, lines = [], [], []
                for rank, t, wanted in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                    cut = t.split(b"\n")
                    for i in wanted:
                        ranks.append(rank)
                        numbers.append(i)
                        lines.append(b" ".join(cut[i].split()))
                both = np.frombuffer(b"".join(xxh3_128_digest(x) for x in lines), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1]), "rank": pa.array(ranks, pa.int64()),
                    "line_no": pa.array(numbers, pa.int32()), "line": pa.array(lines, pa.binary()).cast(pa.string())})

    found = joined.mapInArrow(run, "d1 long, d2 long, rank long, line_no int, line string")
    distinct = found.groupBy("d1", "d2").agg(F.min(F.struct("rank", "line_no", "line")).alias("w"))
    ordered = distinct.select("w.rank", "w.line_no", "d1", "d2", "w.line", F.lit(1).alias("one"))
    return prefix_sums(ordered, ["rank", "line_no", "d1", "d2"], "one", "at").select("at", "d1", "d2", "line")


def variant_keys(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Key of the whole line, of each variant with one word deleted, and of each
    variant with the place of the deleted word."""
    from xxhash import xxh3_64_intdigest
    w = np.array([xxh3_64_intdigest(x) for x in words], np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(w) - 1, _BASE, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w * power, dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    place = mix64(np.arange(len(w), dtype=np.uint64))
    return int(mix64(sums[-1:]).view(np.int64)[0]), mix64(without).view(np.int64), mix64(mix64(without) ^ place).view(np.int64)


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(key, kind, at): kind 0 the line, 1 a word deleted, 2 with the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "line", 1 << 18):
                keys, kinds, at = [], [], []
                for a, line in zip(part.column(0).to_pylist(), texts, strict=True):
                    whole, deleted, placed = variant_keys(line.split())
                    deleted = np.unique(deleted)
                    n = 1 + len(deleted) + len(placed)
                    keys.append(np.concatenate([[whole], deleted, placed]))
                    kinds.append(np.repeat([0, 1, 2], [1, len(deleted), len(placed)]))
                    at.append(np.full(n, a))
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "kind": pa.array(np.concatenate(kinds).astype(np.int8)),
                                                  "at": pa.array(np.concatenate(at))})

    return lines.select("at", "line").mapInArrow(run, "key long, kind byte, at long")


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether edit distance over words is 1 or less."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_lines(lines: DataFrame) -> DataFrame:
    """(d1, d2) of the distinct lines with an earlier neighbour."""
    variants = neighbourhood(lines)
    least = [F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"least{k}") for k in range(3)]
    groups = cut_lineage(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *least).where("n > 1").drop("n"))
    other = F.when(F.col("kind") == 0, F.col("least1")).when(F.col("kind") == 1, F.col("least0")).otherwise(F.col("least2"))
    pairs = (variants.join(groups.hint("merge"), "key").select("at", other.alias("other")).where("other < at").distinct())
    named = (pairs.join(lines, "at").join(lines.select(F.col("at").alias("other"), F.col("line").alias("other_line")), "other")
             .select("d1", "d2", "line", "other_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([one_edit(x.split(" "), y.split(" ")) for x, y in
                                     zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())).select(["d1", "d2"])

    return named.mapInArrow(run, "d1 long, d2 long").distinct()


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rank, text_hash, lines): for each document that loses lines, their numbers."""
    rows = line_rows(docs, text, doc_id)
    near = cut_lineage(near_lines(candidate_lines(docs, rows, text, doc_id)))
    many = rows.where("not again").groupBy("d1", "d2").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the join's sides are plain shuffles and Spark can split a hot line
    known = cut_lineage(many.select("d1", "d2", "least").unionByName(near.withColumn("least", F.lit(-(2**63))))
                        .groupBy("d1", "d2").agg(F.min("least").alias("least")))
    later = rows.where("not again").join(known.hint("merge"), ["d1", "d2"]).where("rank > least").select("rank", "text_hash", "line_no")
    return (later.unionByName(rows.where("again").select("rank", "text_hash", "line_no"))
            .groupBy("rank", "text_hash").agg(F.collect_set("line_no").alias("lines")))


def _with_dropped(docs: DataFrame, text: str, doc_id: str, name: str) -> DataFrame:
    rank, hashed, r, h = fresh(docs, "rank", "text_hash", "r", "h")
    gone = dropped_lines(docs, text, doc_id).toDF(r, h, name)
    keyed = docs.withColumns({rank: F.coalesce(docs[doc_id].cast("long"), F.lit(_LAST)), hashed: F.xxhash64(text_of(docs, text))})
    return keyed.join(gone, (keyed[rank] == gone[r]) & (keyed[hashed] == gone[h]), "left")


def line_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers from 0, ascending), one row per document."""
    counted = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rank, hashed = F.coalesce("doc_id", F.lit(_LAST)), F.xxhash64(text_of(counted, "text"))
    small = counted.select("doc_id", rank.alias("rank"), hashed.alias("text_hash"), F.size(F.split(text_of(counted, "text"), "\n")).cast("long").alias("n_lines"))
    gone = F.coalesce(F.array_sort("lines"), F.array().cast("array<int>"))
    return (small.join(dropped_lines(docs, text, doc_id), ["rank", "text_hash"], "left")
            .select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped")))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the dropped lines; every document stays."""
    [gone] = fresh(docs, "dropped")
    joined = _with_dropped(docs, text, doc_id, gone)
    left = F.array_join(F.filter(F.split(joined[text], "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
