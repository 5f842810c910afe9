import re
from hashlib import sha256

import public_tokenizers
from fixtures import awkward, frame
from test_simhash import brute as components
from test_simhash import fingerprint
from test_substring import WORD
from test_substring import brute as substrings
from test_tokens import check_pack, ids_of

import corpus_pipeline
from sparkrecall.llm import packing, quality
from sparkrecall.session import cut_lineage

SF0001 = "/root/testdata/sf0.001"


def expected(pairs):
    """(doc_id, words) left before packing, by plain Python."""
    rows = []
    for i, t in pairs:
        verdict, cleaned = quality.judge((t or "").encode())
        if verdict[6]:
            rows.append((i, t if cleaned is None else cleaned.decode()))
    best = {}
    for i, t in rows:
        key = sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).digest()
        best[key] = min(best.get(key, (i, t)), (i, t), key=lambda x: (x[0] is None, x[0]))
    rows = list(best.values())
    component = {(i, f): c for i, f, c in components(rows)}
    rows = [(i, t) for i, t in rows if component[i, f"{fingerprint(t):016x}"] == i]
    return substrings(rows)


def before_packing(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF0001)
        assert out.columns == docs.columns
        docs = cut_lineage(out)
    return docs


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    left = before_packing(spark, docs).collect()
    assert sorted(((r.doc_id, WORD.findall(r.text)) for r in left), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.n_chars == len(r.text) for r in left)


def test_run_packs_what_is_left(spark):
    left = before_packing(spark, spark.read.parquet(f"{SF0001}/documents.parquet"))
    rows = corpus_pipeline.run(spark, SF0001).collect()
    with_ids = packing.pack(left, public_tokenizers.path("word_bpe_49k.json"), 1, 2048, with_ids=True).collect()
    check_pack(with_ids, {r.doc_id: [ids_of(r.text) + [1]] for r in left.collect()}, 2048)
    assert sorted(map(tuple, rows)) == sorted(tuple(r)[:7] for r in with_ids)


def test_awkward_rows_pass(spark):
    docs = frame(spark, awkward())
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF0001))
    assert docs.count() > 0
    empty = frame(spark, awkward()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = cut_lineage(stage(spark, empty, SF0001))
    assert empty.count() == 0
