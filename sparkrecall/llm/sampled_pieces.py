"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text (with the model's leading space) is a lattice over its UTF-8 bytes: an edge
is a piece that matches, and characters outside the vocabulary fall back to one edge
per byte. Forward filtering sums the weights of all ways to each byte; backward
sampling draws the edges from the end to the start, so a segmentation is drawn with
its exact probability, the normalised product of its pieces' weights. A piece of rank r
weighs ``1 / (r + 1) ** sharpness``: the model's scores are merge ranks, and word
frequencies fall about so with the rank.

The draw at a byte is a hash of (seed, row key, byte position), so a row has the same
segmentation on every run and cluster, whatever its neighbours. Pieces never cross from
a word into the next space or newline, so the lattice falls into segments; a worker
keeps the filtered lattices of the segments it has met (a bounded table) and draws all
segments of a slice at once in NumPy.

Decoding joins the pieces' bytes and drops the leading space, so it gives the text back
byte for byte, runs of spaces, control characters and the model's space mark (which is
written in bytes) included. A null or empty text has no ids. Rows with a null key draw
as key -1; repeated rows are drawn alike. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkrecall.llm.common import mix64, text_slices
from sparkrecall.llm.span_table import SpanTable, grown

#: Segments and lattice bytes remembered by one worker process.
TABLE_SEGMENTS, TABLE_BYTES = 700_000, 7 << 20
_SAMPLERS: dict = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Slots of the vocabulary's hash table.
_VOCABULARY_BITS = 19


class Sampler(SpanTable):
    """The filtered lattices of the segments met so far.

    A node is the end of a byte of a segment; its edges lie together, from
    ``first[node]`` on: the piece's length, its id, and the cumulated share of the
    node's weight, whose last is the whole."""

    def __init__(self, model: str, sharpness: float = 1.0, table_bytes: int = TABLE_BYTES):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        self.raw: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        pieces, ids, weights = [], [], []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.raw[i] = piece.replace("▁", " ").encode()
                pieces.append(self.raw[i])
                ids.append(i)
                weights.append(-sharpness * np.log1p(min(size, max(0.0, -lib.get_score(i)))))
        if any(b" " in p.lstrip(b" ") or b"\n" in p for p in pieces):
            raise ValueError("pieces cross words; the lattice has no such segments")
        self.byte_weight = -sharpness * np.log1p(size)
        self.most_nodes = table_bytes
        self._index(pieces, np.array(ids, np.int32), np.array(weights))
        super().__init__(TABLE_SEGMENTS)

    def _index(self, pieces: list[bytes], ids: np.ndarray, weights: np.ndarray) -> None:
        """The vocabulary by the hash of its pieces, sorted; the slots of the hashes' top
        bits tell where to look."""
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            x = 0
            for b in p:
                x = (x * int(_BASE) + b + 1) & (1 << 64) - 1
            h[i] = x
        h = mix64(h)
        order = np.argsort(h)
        self.piece_hash, self.piece_id, self.piece_weight = h[order], ids[order], weights[order]
        top = (self.piece_hash >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)
        first = np.searchsorted(top, np.arange((1 << _VOCABULARY_BITS) + 1))
        self.slot_hash = np.full(1 << _VOCABULARY_BITS, ~np.uint64(0), np.uint64)  # of the slot's first piece
        self.slot_place, self.slot_size = first[:-1].astype(np.int32), np.diff(first).astype(np.int8)
        full = np.flatnonzero(self.slot_size)
        self.slot_hash[full] = self.piece_hash[self.slot_place[full]]
        self.longest = max(map(len, pieces))

    def clear(self) -> None:
        super().clear()
        self.n_nodes = self.n_edges = 0
        self.node0, self.first = np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)
        self.share, self.length, self.piece = np.zeros(1 << 14, np.float32), np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.int32)

    def _lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places in the vocabulary."""
        slot = (h >> np.uint64(64 - _VOCABULARY_BITS)).astype(np.int64)
        hit = np.flatnonzero(self.slot_hash[slot] == h)
        found, place = [hit], [self.slot_place[slot[hit]]]
        crowded = np.flatnonzero((self.slot_size[slot] > 1) & (self.slot_hash[slot] != h))
        k = 1
        while len(crowded):
            p = self.slot_place[slot[crowded]] + k
            same = self.piece_hash[p] == h[crowded]
            found.append(crowded[same])
            place.append(p[same])
            k += 1
            crowded = crowded[~same & (self.slot_size[slot[crowded]] > k)]
        return np.concatenate(found), np.concatenate(place)

    def _edges(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, end, id, log weight) of all edges of segments laid end to end, longest
        pieces last; ``end``: for each byte, where its segment ends."""
        lead = (text & 0xC0) != 0x80
        width = np.ones(len(text), np.int64)
        width[text >= 0xC0] = 2
        width[text >= 0xE0] = 3
        width[text >= 0xF0] = 4
        at = np.flatnonzero(lead)
        room = end[at] - at
        h = np.zeros(len(at), np.uint64)
        whole = np.zeros(len(text), bool)  # a piece is this one character
        code = text.astype(np.uint64) + np.uint64(1)
        begins, ends, ids, weights = [], [], [], []
        for k in range(self.longest):
            ok = room > k
            if not ok.all():
                at, h, room = at[ok], h[ok], room[ok]
            if not len(at):
                break
            h = h * _BASE + code[at + k]
            hit, place = self._lookup(mix64(h))
            b = at[hit]
            begins.append(b)
            ends.append(b + (k + 1))
            ids.append(self.piece_id[place])
            weights.append(self.piece_weight[place])
            if k < 4:
                whole[b[width[b] == k + 1]] = True
        # characters without a piece of their own: one edge per byte
        first = np.flatnonzero(lead & ~whole)
        odd = first[:, None] + np.arange(4)
        odd = odd[(np.arange(4) < width[first][:, None]) & (odd < len(text))]
        begins.insert(0, odd)
        ends.insert(0, odd + 1)
        ids.insert(0, self.byte_id[text[odd]])
        weights.insert(0, np.full(len(odd), self.byte_weight))
        return tuple(np.concatenate(x) for x in (begins, ends, ids, weights))

    def _learn(self, text: np.ndarray, size: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        """Forward filtering for new segments, laid end to end, all at once by byte position."""
        begin_of = np.cumsum(size) - size
        segment_begin = np.repeat(begin_of, size)
        begin, end, ids, weight = (x[::-1] for x in self._edges(text, segment_begin + np.repeat(size, size)))
        order = np.argsort(end, kind="stable")  # by node, the longest pieces first
        begin, end, ids, weight = begin[order], end[order], ids[order], weight[order]
        base = segment_begin[end - 1]
        rank = end - base  # edges into the same byte position of their segments are filtered together
        by_rank = np.argsort(rank, kind="stable")
        limits = np.searchsorted(rank[by_rank], np.arange(1, int(size.max()) + 2))
        total = np.full(len(text), -np.inf)  # log weight of all ways to the end of each byte
        share = np.ones(len(end))
        for r in range(len(limits) - 1):
            e = by_rank[limits[r]:limits[r + 1]]
            if not len(e):
                continue
            value = np.where(begin[e] > base[e], total[begin[e] - 1], 0.0) + weight[e]
            node = end[e] - 1
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            if len(heads) == len(e):
                total[node] = value
                continue
            counts = np.diff(np.concatenate([heads, [len(e)]]))
            top = np.maximum.reduceat(value, heads)
            top[~np.isfinite(top)] = 0.0
            part = np.exp(value - np.repeat(top, counts))
            sums = np.add.reduceat(part, heads)
            run = np.cumsum(part)
            run -= np.repeat(run[heads] - part[heads], counts)
            with np.errstate(divide="ignore", invalid="ignore"):
                total[node[heads]] = top + np.log(sums)
                share[e] = np.nan_to_num(run / np.repeat(sums, counts), nan=1.0)
        share[np.flatnonzero(np.concatenate([end[1:] != end[:-1], [True]]))] = 2.0  # the last edge of a node takes the rest
        n, m = self.n_nodes + len(text), self.n_edges + len(end)
        self.first, self.node0 = grown(self.first, self.n_nodes, n), grown(self.node0, self.n, self.n + len(size))
        self.share, self.length, self.piece = (grown(x, self.n_edges, m) for x in (self.share, self.length, self.piece))
        self.first[self.n_nodes:n] = self.n_edges + np.searchsorted(end, np.arange(1, len(text) + 1))
        self.share[self.n_edges:m], self.length[self.n_edges:m], self.piece[self.n_edges:m] = share, end - begin, ids
        self.node0[self.n:self.n + len(size)] = self.n_nodes + begin_of
        self.n_nodes, self.n_edges = n, m
        self.insert(h, c)

    def encode(self, texts: list[bytes], keys: list[int], seed: int) -> list[np.ndarray]:
        """The sampled ids of each text; ``keys`` are the rows' keys."""
        raw = np.frombuffer(b"".join([b" " + t if t else t for t in texts]), np.uint8)
        text_size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_begin = np.cumsum(text_size) - text_size
        if not len(raw):
            return [np.zeros(0, np.int64) for _ in texts]
        # segments: a newline; spaces with the word behind them
        space, line = raw == 32, raw == 10
        opens = line.copy()
        opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        opens[text_begin[text_size > 0]] = True
        begin = np.flatnonzero(opens)
        end = np.concatenate([begin[1:], [len(raw)]])
        size = end - begin
        h, c = self.hashes(raw, begin, end)
        at = self.find(h, c)
        fresh_bytes = int(size[at < 0].sum())  # an upper bound of what is to be learnt
        new = self.unknown(h, at, more=self.n_nodes + fresh_bytes > self.most_nodes)
        if new is not None:
            spans = np.repeat(begin[new] - (np.cumsum(size[new]) - size[new]), size[new]) + np.arange(int(size[new].sum()))
            self._learn(raw[spans], size[new], h[new], c[new])
            missing = np.flatnonzero(at < 0)
            at[missing] = self.find(h[missing], c[missing])
        doc = np.searchsorted(text_begin, begin, side="right") - 1
        salt = mix64(np.array(keys, np.int64).view(np.uint64) ^ mix64(np.array([seed], np.int64).view(np.uint64)))
        out = np.full(len(raw), -1, np.int32)
        node, left, here, salts = self.node0[at].astype(np.int64), size, begin, salt[doc]
        origin = text_begin[doc]
        while len(node):
            u = mix64(salts + (here + left - origin).astype(np.uint64) * _BASE) >> np.uint64(40)
            u = u.astype(np.float32) / np.float32(1 << 24)
            edge = self.first[node + left - 1].astype(np.int64)
            wait = np.flatnonzero(self.share[edge] <= u)
            while len(wait):
                edge[wait] += 1
                wait = wait[self.share[edge[wait]] <= u[wait]]
            left = left - self.length[edge]
            out[here + left] = self.piece[edge]
            go = np.flatnonzero(left > 0)
            node, left, here, salts, origin = node[go], left[go], here[go], salts[go], origin[go]
        return [x[x >= 0].astype(np.int64) for x in np.split(out, text_begin[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.raw[i] for i in ids.tolist()])[1:]


def sampler(model: str, sharpness: float = 1.0) -> Sampler:
    key = model, sharpness
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(model, sharpness)
    return _SAMPLERS[key]


def sample_pieces(docs: DataFrame, model: str, seed: int = 0, sharpness: float = 1.0, text: str = "text", doc_id: str = "doc_id",
                  with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array; with ``with_ids``), n_tokens, ids_crc32 (of the ids as
    little-endian uint32) and lossless (whether the decoded ids are the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_of = sampler(model, sharpness)
        for batch in batches:
            for part, texts in text_slices(batch, "text", 1 << 20):
                keys = part.column(0).fill_null(-1).to_pylist()
                found = model_of.encode(texts, keys, seed)
                out = {"doc_id": part.column(0)}
                if with_ids:
                    out["ids"] = pa.array(found, pa.list_(pa.int64()))
                out |= {"n_tokens": pa.array([len(x) for x in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        "lossless": pa.array([model_of.decode(x) == t for x, t in zip(found, texts, strict=True)])}
                yield pa.RecordBatch.from_pydict(out)

    ids = "ids array<long>, " if with_ids else ""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {ids}n_tokens long, ids_crc32 long, lossless boolean")


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the decoded text in place of the ids (null ids: null)."""
    others = [c for c in rows.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_of = sampler(model)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else model_of.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=[*others, text])

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField(text, T.StringType())])
    return rows.mapInArrow(run, schema)
