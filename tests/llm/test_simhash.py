import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import Sets, awkward, frame
from xxhash import xxh64_intdigest

from sparkrecall.llm import golay, queries, simhash
from sparkrecall.llm.components import components
from sparkrecall.session import table

SF0001 = "/root/testdata/sf0.001"


def fingerprint(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute(pairs):
    fps = [fingerprint(t) for _, t in pairs]
    sets = Sets()
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        sets.find(a)
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    least = defaultdict(list)
    for (i, _), f in zip(pairs, fps, strict=True):
        least[sets.find(f)].append(i)
    return sorted(((i, f"{f:016x}", min((x for x in least[sets.find(f)] if x is not None), default=None))
                   for (i, _), f in zip(pairs, fps, strict=True)), key=str)


def test_golay_code():
    words = np.arange(1 << 12) << 11
    codewords = words | golay.tables()[0]
    weights = np.bitwise_count(codewords)
    assert weights[1:].min() == 7 and (weights == 7).sum() == 253
    keys = golay.codeword_indices(np.array([0, 1, 0b11, 0b111]))
    assert (keys[:3, 1:] == -1).all() and (keys[3] >= 0).all()


def test_golay_keys_meet_within_two_bits():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 2000)
    flips = (1 << rnd.integers(0, 23, 2000)) | (1 << rnd.integers(0, 23, 2000))
    a, b = golay.codeword_indices(words), golay.codeword_indices(words ^ flips)
    for x, y in zip(a, b, strict=True):
        assert set(x[x >= 0].tolist()) & set(y[y >= 0].tolist())


def test_against_all_pairs(spark):
    pairs = awkward()
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame(spark, pairs)).collect()), key=str)
    assert got == brute(pairs)


def test_op4_whole_table(spark):
    pairs = [(r.doc_id, r.text) for r in table(spark, SF0001, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op4_simhash_near_dedup(spark, SF0001).collect()), key=str)
    assert got == brute(pairs)


@pytest.mark.parametrize("bucket", [1, 8, 64])
def test_links_in_crowded_buckets(spark, bucket):
    """Chains and clusters around few words, beyond and within the bucket bound."""
    rnd = random.Random(bucket)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << rnd.randrange(64) | (1 << rnd.randrange(64) if rnd.random() < .6 else 0)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(4)
    edges = simhash.links(df, bucket).collect()
    back = {s: f for f, s in signed.items()}
    mine, real = Sets(), Sets()
    for e in edges:
        assert (back[e.a] ^ back[e.b]).bit_count() <= 2
        mine.join(back[e.a], back[e.b])
    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 2:
                real.join(a, b)
    for a in order:
        for b in order:
            assert (mine.find(a) == mine.find(b)) == (real.find(a) == real.find(b))


def test_components_of_long_paths_and_hubs(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001), (5001, 5000), (7, 7)]
    names = [rnd.getrandbits(63) - 2**62 for _ in range(6000)]
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    sets = Sets()
    for a, b in edges:
        sets.join(names[a], names[b])
    members = defaultdict(list)
    for x in {names[x] for e in edges for x in e}:
        members[sets.find(x)].append(x)
    assert got == {x: min(m) for m in members.values() for x in m if x != min(m)}


def test_near_dedup_keeps_one_of_each(spark):
    pairs = [p for p in awkward() if p[1] != "another text with that id"]  # else two components have one least id
    docs = frame(spark, pairs)
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    component = {(i, f): c for i, f, c in brute(pairs)}
    found = [component[r.doc_id, f"{fingerprint(r.text):016x}"] for r in rows]
    assert len(found) == len(set(found)) == len(set(component.values()))
    assert all(r.doc_id == c for r, c in zip(rows, found, strict=True))


def test_empty(spark):
    docs = frame(spark, awkward()).limit(0)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.near_dedup(docs).count() == 0
