"""Substring deduplication by content-defined chunking.

A gear hash rolls over the text's bytes (white space runs as one space); a chunk ends
after a word where the hash of the last 16 bytes falls below a threshold, so chunk
ends depend on the words just before them alone, and an insertion moves only the ends
near it. From each chunk's start a unit runs over whole chunks until it has
``LEAST_WORDS`` words; units are deduplicated by digest. A unit stays in the document
with the smallest doc_id that has it (there, at its first place) and is cut from all
others, together with what overlapping repeated units cover. A repeated passage so
goes from its first chunk end to its last one; documents keep all else as it was.

Few bytes move: one shuffle of (64-bit digest, 32 more bits, rank), partly aggregated,
gives each digest's count and first document; digests found twice are written, and the
units' (digest, rank, place) join them. Both sides of that join are plain shuffles, so
Spark can split a digest that a third of all rows hold. Digests under which different
further bits were seen (two units by chance) are matched by all 96 bits in a join of
their own. Texts are told apart by a hash beside their doc_id only where ids repeat.

A null text stays null and an empty one empty; texts of fewer than ``LEAST_WORDS``
words are never cut. A null doc_id ranks last. Rows that share a doc_id are not
deduplicated against each other, repeated rows therefore neither. Within one text, a
place that overlaps the unit's first place is no repetition. An empty table gives an
empty result. Other columns, whatever their names, pass through unchanged, except
n_chars, which follows a text that was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrecall.llm.common import fresh, mix64, text_of, text_slices
from sparkrecall.session import cut_lineage

#: Mean words of a chunk, and least words of a unit.
CHUNK_WORDS, LEAST_WORDS = 4, 16
_LAST = 2**63 - 1


#: 256 pseudo-random 64-bit numbers, from a fixed rule.
_GEAR = mix64(np.arange(256, dtype=np.uint64))


def gear_hashes(line: np.ndarray) -> np.ndarray:
    """High 32 bits of the gear hash of the last 16 bytes (h = 2h + gear[byte]) at
    each byte: sums over 1, 2, 4, 8 bytes are doubled instead of rolled."""
    h = _GEAR[line]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint64(k)
        h = more
    return h >> np.uint64(32)


def units(text: bytes, chunk_words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS) -> tuple[list[int], list[int], list[bytes]]:
    """First words, end words and 128-bit digests of the text's units."""
    from xxhash import xxh3_128_digest
    words = text.split()
    if len(words) < least_words:
        return [], [], []
    line = b" ".join(words)
    raw = np.frombuffer(line, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    begin = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(line)]])
    cut = np.flatnonzero(gear_hashes(raw)[spaces - 1] < (1 << 32) // chunk_words) + 1
    starts = np.concatenate([[0], cut])
    stops = np.concatenate([cut, [len(words)]])
    at = np.searchsorted(stops, starts + least_words)
    starts = starts[at < len(stops)]
    stops = stops[at[at < len(stops)]]
    digests = [xxh3_128_digest(line[a:b]) for a, b in zip(begin[starts].tolist(), ends[stops - 1].tolist(), strict=True)]
    return starts.tolist(), stops.tolist(), digests


def again(starts: list[int], stops: list[int], digests: list[bytes]) -> list[bool]:
    """Whether the unit stands earlier in its text, without overlap."""
    if len(set(digests)) == len(digests):
        return [False] * len(digests)
    first: dict[bytes, int] = {}
    return [s >= first.setdefault(d, e) for s, e, d in zip(starts, stops, digests, strict=True)]


def cut_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the word ranges (each with the white space behind it)."""
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])).tolist() + [len(text)]
    out, at = [], 0
    for a, b in sorted(ranges):
        if begin[a] > at:
            out.append(text[at:begin[a]])
        at = max(at, begin[b])
    out.append(text[at:])
    return b"".join(out)


def text_key(docs: DataFrame, text: str, repeated: bool) -> Column:
    """64 bits of hash of a text, which tells apart the texts of rows that share a
    doc_id; 0 where no id is repeated."""
    return F.xxhash64(text_of(docs, text)) if repeated else F.lit(0).cast("long")


def rank_of(docs: DataFrame, doc_id: str) -> Column:
    return F.coalesce(docs[doc_id].cast("long"), F.lit(_LAST))


def ids_repeat(docs: DataFrame, doc_id: str) -> bool:
    return not docs.groupBy(rank_of(docs, doc_id).alias("rank")).count().where("count > 1").isEmpty()


_FIELDS = {"digest": "long", "rest": "int", "rank": "long", "text_hash": "long", "place": "int"}


def _units(rows: DataFrame, fields: list[str], chunk_words: int, least_words: int) -> DataFrame:
    """The asked ``_FIELDS`` of each unit of (rank, text_hash, text) rows: 64 and 32 bits
    of its digest, its document's rank and hash, and its number in the document,
    negative (-1 - number) if it stands earlier there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                n, found, place = [], [], []
                for t in texts:
                    starts, stops, digests = units(t, chunk_words, least_words)
                    n.append(len(digests))
                    found.extend(digests)
                    if "place" in fields:
                        number = np.arange(len(digests), dtype=np.int32)
                        place.append(np.where(again(starts, stops, digests), -1 - number, number))
                both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                out = {"digest": lambda: both[:, 0], "rest": lambda: both[:, 1].astype(np.int32),
                       "rank": lambda: np.repeat(part.column(0).to_numpy(zero_copy_only=False), n),
                       "text_hash": lambda: np.repeat(part.column(1).to_numpy(zero_copy_only=False), n),
                       "place": lambda: np.concatenate(place).astype(np.int32)}
                yield pa.RecordBatch.from_pydict({f: pa.array(out[f]()) for f in fields})

    return rows.mapInArrow(run, ", ".join(f"{f} {_FIELDS[f]}" for f in fields))


def repeated_units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_words: int = CHUNK_WORDS,
                   least_words: int = LEAST_WORDS, repeated_ids: bool = True) -> DataFrame:
    """(rank, text_hash, places): for each document with units to cut, their numbers."""
    rows = docs.select(rank_of(docs, doc_id).alias("rank"), text_key(docs, text, repeated_ids).alias("text_hash"), docs[text].alias("text"))
    twice = cut_lineage(
        _units(rows, ["digest", "rest", "rank"], chunk_words, least_words).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        .where("n > 1").select("digest", "least", (F.col("low") == F.col("high")).alias("one_unit")))
    # written, so that both sides of the join are plain shuffles and Spark can split a hot digest
    where = ["digest", "rank", *(["text_hash"] if repeated_ids else []), "place"]
    cut = (_units(rows, where, chunk_words, least_words).join(twice.where("one_unit").drop("one_unit"), "digest")
           .where("rank > least or place < 0").select(*where[1:]))
    if not twice.where("not one_unit").isEmpty():   # digests that two different units share
        shared = cut_lineage(_units(rows, ["rest", *where], chunk_words, least_words)
                             .join(twice.where("not one_unit").select("digest"), "digest"))
        firsts = cut_lineage(shared.groupBy("digest", "rest").agg(F.min("rank").alias("least")))
        cut = cut.unionByName(shared.join(firsts, ["digest", "rest"]).where("rank > least or place < 0").select(*where[1:]))
    number = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    out = cut if repeated_ids else cut.withColumn("text_hash", F.lit(0).cast("long"))
    return out.groupBy("rank", "text_hash").agg(F.collect_set(number).alias("places"))


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars",
                     chunk_words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS, count: str | None = None) -> DataFrame:
    """``docs`` without the repeated passages; with ``count``, a column of that name
    tells how many words were cut."""
    rank, hashed, places, r_rank, r_hash = fresh(docs, "rank", "text_hash", "places", "r_rank", "r_hash")
    repeated = ids_repeat(docs, doc_id)
    # written, so that a hot id's rows can be split in the join
    cuts = cut_lineage(repeated_units(docs, text, doc_id, chunk_words, least_words, repeated)).toDF(r_rank, r_hash, places)
    keyed = docs.withColumns({rank: rank_of(docs, doc_id), hashed: text_key(docs, text, repeated)})
    same = (keyed[rank] == cuts[r_rank]) & (keyed[hashed] == cuts[r_hash]) if repeated else keyed[rank] == cuts[r_rank]
    joined = keyed.join(cuts, same, "left").select(*docs.columns, places)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text)
            for part, texts in text_slices(batch, text):
                lists, lost, new, columns = part.column(len(names)).to_pylist(), [], [], part.columns[:-1]
                for t, numbers in zip(texts, lists, strict=True):
                    if not numbers:
                        lost.append(0)
                        new.append(t)
                        continue
                    starts, stops, _ = units(t, chunk_words, least_words)
                    left = cut_words(t, [(starts[i], stops[i]) for i in numbers])
                    lost.append(len(t.split()) - len(left.split()))
                    new.append(left)
                if any(lost):
                    changed = pa.array([n > 0 for n in lost])
                    fresh_text = pa.array(new, pa.binary()).cast(columns[at].type)
                    columns[at] = pc.if_else(changed, fresh_text, columns[at])
                    if n_chars in names:
                        k = names.index(n_chars)
                        columns[k] = pc.if_else(pc.and_(changed, columns[k].is_valid()),
                                                        pc.utf8_length(fresh_text).cast(columns[k].type), columns[k])
                extra = [pa.array(lost, pa.int64())] if count else []
                yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *([count] if count else [])])

    schema = T.StructType([*docs.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])
    return joined.mapInArrow(run, schema)
