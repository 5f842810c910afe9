import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkrecall.llm import packing, queries, token_files
from sparkrecall.llm.token_ids import Encoder
from sparkrecall.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF0001 = "/root/testdata/sf0.001"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sΣ́ \x1c<|>")), max_size=40), max_size=4))
def test_word_table_equals_whole_texts(texts):
    enc = Encoder(PATH, table_words=20)
    raw = [t.encode() for t in texts] + [b"it's <|endoftext|>x don't"]
    for _ in range(2):
        ids, ends = enc.encode(raw)
        begin = 0
        for t, e in zip(raw, ends.tolist(), strict=True):
            assert ids[begin:e].tolist() == ids_of(t.decode())
            begin = e


def test_long_text_in_pieces():
    text = ("word number and more " * 300_000).encode()
    enc = Encoder(PATH)
    [ids] = enc.with_end([text], 2)
    assert len(ids) == 1 + 300_000 * len(ids_of("word number and more")) and ids[-1] == 2


def test_token_files(spark, tmp_path):
    pairs = awkward()
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write_token_files(frame(spark, pairs), folder, PATH, 2, shards=3)
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    assert manifest["n_docs"] == len(pairs) and manifest["dtype"] == "<u2"
    rows = sorted(got, key=lambda r: r.start)
    start = 0
    texts = defaultdict(list)
    for i, t in pairs:
        texts[i].append(ids_of(t) + [2])
    for a, b in zip(rows, rows[1:], strict=False):
        assert (a.doc_id if a.doc_id is not None else -1) <= (b.doc_id if b.doc_id is not None else -1)
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        texts[r.doc_id].remove(list(r.ids))
        start += r.n_tokens
    assert not any(texts.values()) and start == manifest["n_tokens"]
    one = token_files.Shard(folder, manifest["shards"][0]["shard"], "<u2")
    assert isinstance(one.ids, np.memmap) and one[0].tolist() == list(rows[0].ids)


def test_rows_without_an_id_span_shards(spark, tmp_path):
    pairs = [(None, f"text {i}") for i in range(400)] + [(7, f"other {i}") for i in range(400)] + [(i, "x") for i in range(50)]
    manifest = token_files.write_token_files(frame(spark, pairs), str(tmp_path), PATH, 2, shards=8)
    assert max(s["n_docs"] for s in manifest["shards"]) < 300
    rows = sorted(token_files.read_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len(ids) == len(pairs)


def test_token_files_empty(spark, tmp_path):
    assert token_files.token_table(frame(spark, awkward()).limit(0), PATH, 2, folder=str(tmp_path)).count() == 0


def test_op2_whole_table(spark):
    got = {r.doc_id: r for r in queries.op2_token_files(spark, SF0001).collect()}
    start = 0
    for r in table(spark, SF0001, "documents").orderBy("doc_id").collect():
        ids = ids_of(r.text) + [2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_pack(rows, texts, length):
    """Every id in one piece; sequences gapless, full but for the last."""
    docs = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == crc(r.ids)
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, wanted in texts.items():
        mine = sorted(docs.pop(i), key=lambda r: r.start)
        if len(wanted) == 1:
            assert [x for r in mine for x in r.ids] == wanted[0] and mine[0].doc_tokens == len(wanted[0])
        assert sum(r.length for r in mine) == sum(map(len, wanted))
    assert not docs
    for k, s in sequences.items():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        assert sum(r.length for r in s) == length or k == max(sequences)


@pytest.mark.parametrize("length", [64, 2048])
def test_pack(spark, length):
    pairs = awkward()
    rows = packing.pack(frame(spark, pairs), PATH, 1, length, with_ids=True).collect()
    texts = defaultdict(list)
    for i, t in pairs:
        texts[i].append(ids_of(t) + [1])
    check_pack(rows, texts, length)


def test_pack_empty(spark):
    assert packing.pack(frame(spark, awkward()).limit(0), PATH).count() == 0


def test_op10_whole_table(spark):
    rows = queries.op10_packing(spark, SF0001).collect()
    docs = {r.doc_id: ids_of(r.text) + [1] for r in table(spark, SF0001, "documents").collect()}
    for r in rows:
        piece = docs[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(piece) and r.ids_crc32 == crc(piece) and r.doc_tokens == len(docs[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    assert len({r.sequence_id for r in rows}) == -(-sum(map(len, docs.values())) // 2048)


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n).astype(np.int64)
    at = packing.hilbert(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_similar_texts_are_near_on_the_curve(spark):
    import random
    rnd = random.Random(1)
    kinds = ["red green blue orange violet".split(), "one two three four five six".split(), "cat dog horse bird fish".split()]
    pairs = [(i, " ".join(rnd.choice(kinds[i % 3]) for _ in range(300))) for i in range(90)]
    rows = packing.pack(frame(spark, pairs), PATH, 1, 2048).collect()
    order = [r.doc_id % 3 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    changes = sum(a != b for a, b in zip(order, order[1:], strict=False))
    assert changes < 20
