import hashlib
import math
import random
import re
import zlib

import pytest
from fixtures import WORDS, awkward, frame, prose
from pyspark.sql import functions as F

from sparkrecall.llm import queries, resampling

SF0001 = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def buckets_of(text, run=1, buckets=10_000):
    ws = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    grams = [" ".join(ws[i:i + n]) for n in range(1, run + 1) for i in range(len(ws) - n + 1)]
    return len(ws), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute(pairs, targets, percent=10, run=1, buckets=10_000, least=20, seed=2024):
    found = [(i, *buckets_of(t, run, buckets)) for i, t in pairs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, bs in found:
        for b in bs:
            s[b] += 1
    for text in targets:
        for b in buckets_of(text, run, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        rows.append([i, n, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], 2**63 if r[0] is None else r[0]))
    for n, r in enumerate(enough[:percent * len(enough) // 100]):
        r[5] = n + 1
    return sorted(((i, *rest) for i, _, *rest in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def targets(seed=2):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS[:20]) for _ in range(30)) for _ in range(8)] + [None, ""]


@pytest.mark.parametrize("percent,run,pivots", [(10, 1, 16), (50, 2, 1), (100, 3, 3), (0, 1, 2)])
def test_against_brute_force(spark, percent, run, pivots):
    pairs, wanted = awkward(), targets()
    target = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "doc_id long, text string")
    got = resampling.resample(frame(spark, pairs), target, percent, run=run, buckets=500, pivots=pivots)
    assert rows_of(got) == brute(pairs, wanted, percent, run, 500)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(resampling, "WINDOW", 40)
    text = "Ärger, " * 9 + "x" * 100 + " y é" * 30
    for run in (1, 2, 4):
        parts = list(resampling.features(text.encode(), run, resampling._Buckets(1000)))
        assert len(parts) > 3 and sum(n for n, _ in parts) == buckets_of(text)[0]
        assert sorted(b for _, bs in parts for b in bs) == sorted(buckets_of(text, run, 1000)[1])


def test_kth_key_among_ties(spark):
    rnd = random.Random(1)
    rows = [(u, rnd.choice([3, 5, None]), rnd.choice([0, 1, -7])) for u in range(200)]
    df = spark.createDataFrame(rows, "uid long, doc_id long, score long").repartition(4)
    want = sorted((-s, 2**63 - 1 if i is None else i, u) for u, i, s in rows)
    for k in (1, 2, 77, 199, 200):
        assert resampling.kth_key(df, k, seed=k, pivots=4) == want[k - 1]
    assert resampling.kth_key(df, 201, 0) is None and resampling.kth_key(df, 0, 0) is None


def test_empty(spark):
    docs, none = frame(spark, awkward()), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert rows_of(resampling.resample(docs, none)) == brute(awkward(), [])


def test_whole_table(spark):
    table = lambda t: spark.read.parquet(f"{SF0001}/{t}.parquet")
    pairs = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    got = queries.op13_importance_resampling(spark, SF0001)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert rows_of(got) == brute(pairs, [r.text for r in table("benchmark").collect()])
    assert got.where(F.col("rank").isNotNull()).count() > 0


def test_prose_near_the_target_is_drawn(spark):
    rnd = random.Random(4)
    near = [" ".join(rnd.choice(WORDS[:20]) for _ in range(200)) for _ in range(20)]
    far = [prose(rnd, 200) for _ in range(180)]
    target = spark.createDataFrame([(t,) for t in targets()], "text string")
    got = resampling.resample(frame(spark, list(enumerate(near + far))), target).where("rank is not null").collect()
    assert len(got) == 20 and sum(r.doc_id < 20 for r in got) >= 18
