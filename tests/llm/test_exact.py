import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from fixtures import awkward, frame

from sparkrecall.llm import exact_dedup, oracles, queries

SF0001 = "/root/testdata/sf0.001"


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("counters", [2, 256])
def test_against_grouping(spark, counters):
    pairs = awkward()
    got = exact_dedup.classify(exact_dedup.digest_rows(frame(spark, pairs)), counters).collect()
    groups = defaultdict(list)
    for i, t in pairs:
        groups[sha256(normal(t).encode()).digest()].append(i)
    assert len(got) == len(pairs)
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.keep_id == min((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_deduplicate_keeps_columns(spark):
    pairs = awkward()
    docs = frame(spark, pairs)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter(normal(r.text) for r in rows) == Counter(dict.fromkeys({normal(t) for _, t in pairs}, 1))
    assert {(r.doc_id, r.text) for r in rows} <= set(pairs)


def test_repeated_rows_with_a_map_column(spark):
    from sparkrecall.llm import simhash
    rows = [(1, "one text that is here twice", {"a": 1}), (1, "one text that is here twice", {"b": 2}), (None, "x", None), (None, "x", {}),
            (2, "one text  that is here twice", {"c": 3}), (3, "something else again", {"d": 4})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(2)
    for out in (exact_dedup.deduplicate(docs), simhash.near_dedup(docs)):
        got = out.collect()
        assert out.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in got if r.doc_id != 2) == [
            ("1", rows[0][1]), ("3", rows[5][1]), ("None", "x")]


def test_misra_gries_names_every_frequent_value(spark):
    values = [b"a"] * 400 + [b"b"] * 250 + [str(i).encode() for i in range(350)]
    df = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(5)
    found = {bytes(r.key) for r in exact_dedup.misra_gries(df, "digest", 4).collect()}
    assert {b"a", b"b"} <= found and len(found) <= 4


def test_empty(spark):
    docs = frame(spark, awkward()).limit(0)
    assert exact_dedup.deduplicate(docs).count() == 0
    assert exact_dedup.classify(exact_dedup.digest_rows(docs)).count() == 0


def test_oracle(spark):
    got = {tuple(r) for r in queries.op3_exact_dedup(spark, SF0001).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    want = duckdb.sql(oracles.ORACLES["op3_exact_dedup"]).select("doc_id, keep_id, group_size, kept, text_sha256").fetchall()
    assert got == set(want)
