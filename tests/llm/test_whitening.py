import math

import numpy as np
import pytest

from sparkrecall.llm import queries, whitening

SF0001 = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, copies int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "k", "x", 2) for i, v in rows], SCHEMA).repartition(parts)


def some(n=60, d=6, seed=3):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)) * np.arange(1, d + 1)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(base)]
    rows += [(1000 + i, rows[4][1]) for i in range(n // 2)]        # one vector of a third of all rows
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, [round(v, 1) for v in rows[9][1]])]
    bad = [(901, None), (902, []), (903, [1.0] * (d - 1) + [None]), (904, [math.nan] * d), (905, [math.inf] + [0.0] * (d - 1)),
           (906, [0.5] * (d + 1))]
    return rows, rows + bad


def brute(rows, weigh, components=16):
    x = [[math.floor(64 * v) + 1000000 for v in r] for _, r in rows]
    kinds = sorted(set(map(tuple, x)))
    w = [sum(tuple(v) == k for v in x) if weigh else 1 for k in kinds]
    n, sums = sum(w), [sum(a * k[j] for a, k in zip(w, kinds)) for j in range(len(kinds[0]))]
    centred = np.array([[(n * a - s) / n for a, s in zip(k, sums)] for k in kinds])
    cov = (centred * np.array(w)[:, None]).T @ centred / n
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    rows_c = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], rows_c @ columns[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


@pytest.mark.parametrize("weigh", [False, True])
def test_against_plain_arithmetic(spark, weigh):
    good, rows = some()
    got = whitening.whiten(frame(spark, rows), components=4, weigh_copies=weigh).collect()
    n, deviation, white, explained = brute(good, weigh, 4)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want = sorted((i if i is not None else -1, c + 1, dev, round(abs(float(white[k][c])), 8), round(float(explained[c]), 10))
                  for k, ((i, _), dev) in enumerate(zip(good, deviation)) for c in range(4))
    assert sorted((r.id if r.id is not None else -1, r.component, r.deviation, round(abs(r.whitened), 8), round(r.explained, 10))
                  for r in got) == want
    signs = [np.sign([r.whitened for r in got if r.component == c and r.id == 4][0] * white[4][c - 1]) for c in range(1, 5)]
    for r in got:   # one sign for all rows of a component
        at = next(k for k, (i, _) in enumerate(good) if i == r.id)
        assert math.isclose(r.whitened, signs[r.component - 1] * white[at][r.component - 1], abs_tol=1e-8)


def test_too_few_vectors(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0      # no spread
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0, 2.0])])).collect()   # one direction
    assert {(r.id, r.component, r.n) for r in got} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)


def test_huge_entries_and_long_vectors(spark):
    rows = [(i, [float(v) * 3e37, float(i % 3)] + [0.0] * 1500) for i, v in enumerate([1, -1, 2, 0, 1])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.id for r in got} == set(range(5)) and all(math.isfinite(r.whitened) for r in got)
    assert {r.deviation for r in got if r.id == 0} == {None}   # beyond a long


def test_whole_table(spark):
    got = queries.op11_embedding_whitening(spark, SF0001)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()
    n, deviation, white, explained = brute([(r.vec_id, r.embedding) for r in table], False)
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(rows) == 16 * len(table)
    for k, r in enumerate(table):
        for c in range(16):
            out = rows[r.vec_id, c + 1]
            assert out.n == n and out.deviation == deviation[k] and math.isclose(out.explained, explained[c], rel_tol=1e-9)
            assert math.isclose(abs(out.whitened), abs(white[k][c]), abs_tol=1e-6)
