"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's token ids are hashed to a signed vector, projected to few
dimensions (both at once: a fixed pseudo-random row per id, summed and divided by
the root of the count), and the point's place on a Hilbert curve is its key.
Documents are range-sorted by key, so neighbours on the curve, which have similar
words, share sequences. Their ids are laid end to end and cut at multiples of the
sequence length: every sequence but the last is full, and each id is in one piece.

Only (key, doc_id, length) rows are sorted; a document's ids are written once and
joined to its place afterwards. Ties in the key fall back to doc_id, then to the
row's own number, so copies that hold a third of all rows are dealt out evenly.

A null or empty text has only the end id. Null ids sort first within their key.
Repeated rows are all packed. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import mix64, prefix_sums, text_slices
from sparkrecall.llm.token_ids import encoder, id_type
from sparkrecall.session import cut_lineage

DIMENSIONS = 4
#: Bits per dimension of the curve's grid.
GRID_BITS = 12


def projection(ids: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 1) -> np.ndarray:
    """A row of ``dimensions`` numbers of variance 1 for each id: the product of its
    hashed unit vector with a fixed random matrix."""
    cells = ids.astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64)
    u = mix64(cells + np.uint64(seed << 40)) >> np.uint64(11)
    return (u.astype(np.float64) / (1 << 53) - 0.5) * np.sqrt(12.0)


def grid(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Points to cells of the curve's grid; a smooth squash keeps all of them on it."""
    return np.minimum((1 << bits) - 1, (0.5 + np.arctan(points) / np.pi) * (1 << bits)).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Index of each cell (rows of coordinates) on the Hilbert curve. The coordinates
    are made the curve's transposed Gray code, from the high bit down, and interleaved."""
    x = cells.T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level) & 1 == 1
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def tokens_with_keys(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool, text: str, doc_id: str) -> DataFrame:
    """Written table (uid, doc_id, key, n, ids as bytes)."""
    dtype = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                if table is None:
                    enc = encoder(tokenizer, by_word)
                    table = projection(np.arange(enc.library.get_vocab_size() + 1, dtype=np.uint64)).astype(np.float32)
                points, raw, n = np.zeros((len(texts), DIMENSIONS)), [], []
                for i, ids in enumerate(enc.with_end(texts, end_id)):
                    points[i] = table[ids[:-1]].sum(0, dtype=np.float64) / np.sqrt(max(1, len(ids) - 1))
                    raw.append(ids.astype(dtype).tobytes())
                    n.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hilbert(grid(points))), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                    names=["uid", "doc_id", "key", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].alias("text"))
    return cut_lineage(rows.mapInArrow(run, "uid long, doc_id long, key long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, by_word: bool = True, text: str = "text",
         doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` also the ids."""
    dtype = id_type(tokenizer)
    tokens = tokens_with_keys(docs, tokenizer, end_id, by_word, text, doc_id)
    placed = prefix_sums(tokens.select("key", "doc_id", "uid", "n"), ["key", "doc_id", "uid"], "n", "at").select("uid", "at")
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids array<long>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            pieces: list[np.ndarray] = []
            for doc, raw, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(raw, dtype)
                begin = 0
                while begin < len(ids):
                    sequence, offset = divmod(at + begin, length)
                    piece = ids[begin:begin + length - offset]
                    values = doc, begin, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
                    if with_ids:
                        pieces.append(piece.astype("i8"))
                    begin += len(piece)
            out = dict(zip(names, (pa.array(r, pa.int64()) for r in rows), strict=True))
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(pieces, pa.list_(pa.int64()))} if with_ids else {}))

    return tokens.select("uid", "doc_id", "ids").join(placed, "uid").select("doc_id", "ids", "at").mapInArrow(run, schema)
