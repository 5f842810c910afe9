import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from fixtures import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrecall.llm import queries, sampled_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SAMPLER = sampled_pieces.Sampler(MODEL, table_bytes=400)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁aé日\t")), max_size=30), max_size=4), st.integers(0, 9))
def test_lossless(texts, seed):
    raw = [t.encode() for t in texts]
    for t, ids in zip(raw, SAMPLER.encode(raw, list(range(len(raw))), seed), strict=True):
        assert SAMPLER.decode(ids) == t
        if b"\xe2\x96\x81" not in t and b"\x00" not in t:
            assert LIBRARY.decode(ids.tolist()).encode() == t


def segmentations(text, vocabulary):
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in vocabulary:
            i, w = vocabulary[text[:n]]
            out += [((i, *rest), w + more) for rest, more in segmentations(text[n:], vocabulary)]
    return out


def test_drawn_with_the_lattice_probabilities():
    vocabulary = {}
    for i in range(LIBRARY.get_piece_size()):
        if not (LIBRARY.is_control(i) or LIBRARY.is_unknown(i) or LIBRARY.is_byte(i)):
            vocabulary[LIBRARY.id_to_piece(i)] = (i, -math.log1p(min(LIBRARY.get_piece_size(), -LIBRARY.get_score(i))))
    for word in ("there", "cats  in"):
        ways = segmentations("▁" + word.replace(" ", "▁"), vocabulary)
        total = sum(math.exp(w) for _, w in ways)
        n = 40_000
        drawn = Counter(tuple(x.tolist()) for x in SAMPLER.encode([word.encode()] * n, list(range(n)), 3))
        for ids, w in ways:
            p = math.exp(w) / total
            assert abs(drawn.pop(ids, 0) - n * p) < 6 * math.sqrt(n * p * (1 - p)) + 2
        assert not drawn


def test_a_row_is_drawn_alike_in_any_company():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["there", "cats", "walking", "über", "日本"]) for _ in range(30)).encode() for _ in range(40)]
    one = [SAMPLER.encode([t], [k], 5)[0] for k, t in enumerate(texts)]
    other = sampled_pieces.Sampler(MODEL)
    order = rnd.sample(range(40), 40)
    all_of = dict(zip(order, other.encode([texts[k] for k in order], order, 5), strict=True))
    assert all(np.array_equal(one[k], all_of[k]) for k in range(40))
    again = SAMPLER.encode(texts, list(range(40)), 6)
    assert any(not np.array_equal(a, b) for a, b in zip(one, again, strict=True))


def test_round_trip_of_a_table(spark):
    pairs = [*awkward(), (9, "x" * 50_000)]
    rows = sampled_pieces.sample_pieces(frame(spark, pairs), MODEL, seed=2)
    assert rows.count() == len(pairs) and rows.where("not lossless").count() == 0
    back = sampled_pieces.decode_pieces(rows, MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in pairs), key=str)
    assert sampled_pieces.sample_pieces(frame(spark, pairs).limit(0), MODEL).count() == 0


def test_op1_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    own = sampled_pieces.Sampler(MODEL)
    want = {d.doc_id: ids for d, ids in zip(docs, own.encode([(d.text or "").encode() for d in docs], [d.doc_id for d in docs], 7), strict=True)}
    import zlib
    for r in queries.op1_sampled_pieces(spark, "/root/testdata/sf0.001").collect():
        assert r.ids == " ".join(map(str, want[r.doc_id].tolist()))
        assert r.lossless and r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id].astype("<u4").tobytes())
