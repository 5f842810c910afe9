import random

import pytest
from fixtures import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrecall.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(pairs):
    """All pairs of lines with a word, in order."""
    lines = []
    for k, (i, t) in enumerate(pairs):
        for n, line in enumerate((t or "").split("\n")):
            words = line.encode().split()
            if words:
                lines.append((ld._LAST if i is None else i, n, tuple(words), k))
    out = {k: [] for k in range(len(pairs))}
    least = {}
    for rank, n, w, _ in lines:
        least[w] = min(least.get(w, (rank, n)), (rank, n))
    long = [w for w in least if len(w) >= ld.NEAR_WORDS]
    near = {w for w in long if any(least[x] < least[w] and abs(len(x) - len(w)) < 2 and distance(x, w) <= 1 for x in long)}
    seen_in = {}
    for rank, n, w, k in lines:
        if w in near or rank > least[w][0] or (k, w) in seen_in:
            out[k].append(n)
        seen_in[k, w] = True
    return out


def edited(rnd, words):
    i = rnd.randrange(len(words))
    return [words[:i] + words[i + 1:], words[:i] + ["new"] + words[i:], words[:i] + [f"x{rnd.randrange(4)}"] + words[i + 1:]][rnd.randrange(3)]


def test_against_all_pairs(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(300)}" for _ in range(rnd.randint(4, 40))] for _ in range(16)]
    pairs = awkward()[:70] + [(None, "a b\na b\nc"), (None, "c")]
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(base)
            for _ in range(rnd.randrange(3)):
                words = edited(rnd, words)
            lines.append("  ".join(words))
        pairs.append((50_000 + rnd.randrange(10**6), "\n".join([*lines, "", "short one", *lines[:1]])))
    docs = frame(spark, pairs)
    want = brute(pairs)
    expected = sorted(((i, len((t or "").split("\n")), len(want[k]), want[k]) for k, (i, t) in enumerate(pairs)), key=str)
    assert sorted((tuple(r) for r in ld.line_verdicts(docs).collect()), key=str) == expected
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted(((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k]))
                           for k, (i, t) in enumerate(pairs)), key=str)


def test_short_lines(spark):
    """From five words on one edit makes a neighbour; four words must be equal."""
    pairs = [(1, "a b c d e\nh i j k"), (2, "a b x d e\nh i x k"), (3, "a b d e"), (4, "a b c d e f"), (5, "h i j k")]
    got = {r.doc_id: list(r.dropped) for r in ld.line_verdicts(frame(spark, pairs)).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0], 5: [0]}


def test_templated_lines(spark):
    """Very many lines that all differ in the same one word: only the first stays."""
    line = "page number {} of the long report that all of these documents hold in their foot"
    pairs = [(i, line.format(i)) for i in range(600)]
    rows = ld.line_verdicts(frame(spark, pairs)).collect()
    assert {r.doc_id for r in rows if not r.n_dropped} == {0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.lists(st.sampled_from("abc"), min_size=1, max_size=8))
def test_one_edit(a, b):
    assert ld.one_edit(a, b) == (distance(a, b) <= 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=ld.NEAR_WORDS, max_size=14), st.integers(0, 10**9))
def test_neighbours_share_a_key(words, seed):
    rnd = random.Random(seed)
    other = [x if isinstance(x, bytes) else x.encode() for x in edited(rnd, words)]
    if len(other) < 2:
        return
    whole, deleted, placed = ld.variant_keys(words)
    whole2, deleted2, placed2 = ld.variant_keys(other)
    assert whole == whole2 or whole in deleted2 or whole2 in deleted or set(placed.tolist()) & set(placed2.tolist())
    if len(other) >= ld.NEAR_WORDS:
        ends = {(k, e) for k in ld.end_lengths(len(words)) for e in (tuple(words[:k]), tuple(words[-k:], ))}
        ends2 = {(k, e) for k in ld.end_lengths(len(other)) for e in (tuple(other[:k]), tuple(other[-k:]))}
        assert ends & ends2


@pytest.mark.parametrize("n", [ld.NEAR_WORDS, 6, 7, 8, 9, 16, 17, 18, 33, 100])
def test_end_lengths(n):
    assert all(2 * k < n for k in ld.end_lengths(n)) and ld.end_lengths(n)


def test_empty(spark):
    docs = frame(spark, awkward()).limit(0)
    assert ld.line_verdicts(docs).count() == 0 and ld.dedup_lines(docs).count() == 0


def test_oracle(spark):
    import duckdb

    from sparkrecall.llm import oracles, queries
    sf = "/root/testdata/sf0.001"
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(oracles.ORACLES["op5_line_dedup"]).select("doc_id, n_lines, n_dropped, dropped").fetchall()
    got = queries.op5_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "dropped").collect()
    assert sorted(map(tuple, got)) == sorted(want)
