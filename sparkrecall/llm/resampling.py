"""Importance resampling towards a target distribution.

Hashed runs of words are counted over all documents and over the target texts (one
array of bucket counts per task, added up by bucket). A bucket's gain compares its
shares in the two; gains are one array, and a document's weight is the sum of the
gains of its features, read from that array (array scoring). Gumbel noise from a hash
of the seed and doc_id is added, so the highest scores are a weighted draw without
replacement that can be repeated.

The draw is a distributed quickselect: in each round a few random rows of those still
in question serve as pivot keys, one aggregation counts exactly the rows before, at
and after each of them, and the range narrows until a pivot is the k-th key. Only
pivots and counts reach the driver. The rows at or before that key, and no others,
are range-sorted and ranked.

Rows are ordered by falling score, then doc_id (null last), then a row number, so the
order is total also for repeated rows. Null and empty texts have no features and
weigh 0. Words and features of very long texts are counted in slices. Empty documents
give an empty result, an empty target makes gains of the documents alone; other
columns are not read. A null doc_id hashes as the empty text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import text_slices
from sparkrecall.operators.ordering import global_rank
from sparkrecall.session import cut_lineage

#: Hashes of features that a task remembers; it starts anew when they are used up.
REMEMBERED = 1 << 18
#: Bytes of a text that are split into words at once.
WINDOW = 1 << 20
#: Pivot keys of one round of the selection.
PIVOTS = 16

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a UTF-8 text, A-Z lower-cased: runs of ASCII letters and
    digits and of all characters beyond ASCII. Long texts come in several lists, cut
    between words."""
    begin = 0
    while len(text) - begin > WINDOW:
        end = begin + WINDOW
        while end < len(text) and _KEEP[text[end]] != 32:
            end += 1
        yield text[begin:end].translate(_KEEP).split()
        begin = end
    yield text[begin:].translate(_KEEP).split()


class _Buckets(dict):
    """Bucket by feature, worked out on first use."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, run: int, known: _Buckets) -> Iterator[tuple[int, list[int]]]:
    """(words, feature buckets) of a text, in bounded pieces: all runs of 1 to ``run`` words."""
    tail: list[bytes] = []
    for ws in words(text):
        found = [known[w] for w in ws]
        for n in range(2, run + 1):   # longer runs that end in this piece
            joined = tail[len(tail) - min(n - 1, len(tail)):] + ws
            found += [known[b" ".join(joined[i:i + n])] for i in range(len(joined) - n + 1)]
        yield len(ws), found
        tail = (tail + ws)[-(run - 1):] if run > 1 else []


def bucket_counts(texts: DataFrame, text: str, run: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: one array per task, added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, parts in text_slices(b, "text"):
                for t in parts:
                    for _, found in features(t, run, known):
                        total += np.bincount(np.array(found, np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    summed = (texts.select(texts[text].alias("text")).mapInArrow(count, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect())   # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in summed:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) by bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * (s_all + b)) / ((int(s) + 1) * (t_all + b))))
                     for s, t in zip(source, target, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str, doc_id: str, run: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    spark, held = docs.sparkSession, docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        known = _Buckets(len(g))
        for b in batches:
            for part, texts in text_slices(b, "text"):
                rows = []
                for t in texts:
                    n_words = n = weight = 0
                    for k, found in features(t, run, known):
                        n_words, n, weight = n_words + k, n + len(found), weight + int(g[found].sum()) if found else weight
                    rows.append((n_words, n, weight))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
            .mapInArrow(score, "doc_id long, n_words long, n_features long, weight long"))


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _last_id() -> Column:
    return F.coalesce("doc_id", F.lit(2**63 - 1))


def _key() -> Column:
    return F.struct((-F.col("score")).alias("score"), _last_id().alias("doc_id"), F.col("uid").alias("uid"))


def _literal(key: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(key, ("score", "doc_id", "uid"), strict=True)])


def kth_key(rows: DataFrame, k: int, seed: int, pivots: int = PIVOTS) -> tuple[int, int, int] | None:
    """The k-th least key (1-based) of a written table (uid, doc_id, score); None if k
    is not between 1 and the number of rows.

    Each round takes up to ``pivots`` random rows of those in question and counts the
    rows in question before and at each. The k-th key is then one of them or lies
    between two neighbours. Every pivot leaves the range, so the rounds end."""
    keyed = rows.select(_key().alias("key"))
    low = high = None   # the k-th key lies strictly between; k counts from low
    turn = 0
    while k >= 1:
        open_range = F.lit(True)
        if low:
            open_range = open_range & (F.col("key") > _literal(low))
        if high:
            open_range = open_range & (F.col("key") < _literal(high))
        within = keyed.where(open_range)
        draw = F.xxhash64("key", F.lit(seed), F.lit(turn))
        chosen = sorted(tuple(r.key) for r in within.orderBy(draw, "key").limit(pivots).collect())
        if not chosen:
            return None   # fewer than k rows
        counts = within.agg(*[F.count_if(F.col("key") < _literal(p)) for p in chosen],
                            *[F.count_if(F.col("key") == _literal(p)) for p in chosen]).first()
        before, at = counts[:len(chosen)], counts[len(chosen):]
        turn, floor = turn + 1, 0
        for p, b, a in zip(chosen, before, at, strict=True):
            if k <= b:
                high = p
                break
            if k <= b + a:
                return p
            low, floor = p, b + a
        k -= floor
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, *, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text", run: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
             pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: of the rows
    with at least ``least_words`` words, ``percent`` in a hundred are drawn and ranked
    from 1; the others' rank is null."""
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets))
    scored = weighted(docs, gain, text, doc_id, run).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    rows = cut_lineage(scored.withColumn("uid", F.monotonically_increasing_id()))
    enough = rows.where(F.col("n_words") >= least_words)
    k = percent * enough.count() // 100
    last = kth_key(enough, k, seed, pivots)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (_key() <= _literal(last))
    winners = global_rank(rows.where(drawn).withColumns({"_k1": -F.col("score"), "_k2": _last_id()}), ["_k1", "_k2", "uid"], out="rank")
    return (winners.select(*columns, (F.col("rank") + 1).alias("rank"))
            .unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))))
