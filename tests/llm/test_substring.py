import random
import re

import pytest
from fixtures import awkward, frame, prose

from sparkrecall.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(pairs):
    """The texts left, by scanning documents in order with one table of all units."""
    seen, out = {}, []
    groups = {}
    for i, t in pairs:
        groups.setdefault(sd._LAST if i is None else i, []).append((i, t))
    for rank in sorted(groups):
        new = {}
        for i, t in groups[rank]:
            words = WORD.findall(t or "")
            starts, stops, _ = sd.units((t or "").encode())
            cut, first = set(), {}
            for a, b in zip(starts, stops, strict=True):
                unit = tuple(words[a:b])
                if unit in seen or a >= first.setdefault(unit, b):
                    cut.update(range(a, b))
                new[unit] = True
            out.append((i, [w for k, w in enumerate(words) if k not in cut]))
        seen.update(new)
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = awkward()
    shared = [prose(rnd, 70) for _ in range(4)]
    for k in range(40):
        pairs.append((20_000 + k, prose(rnd, rnd.randint(0, 60)) + "\n" + shared[k % 4] + "\n" + prose(rnd, rnd.randint(0, 60))))
    docs = frame(spark, pairs)
    got = sd.dedup_substrings(docs, count="n_cut")
    assert got.columns == [*docs.columns, "n_cut"]
    rows = got.collect()
    assert sorted(((r.doc_id, WORD.findall(r.text or "")) for r in rows), key=str) == brute(pairs)
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, []).append(t)
    for r in rows:
        assert r.n_chars == (None if r.text is None else len(r.text))
        if not r.n_cut:
            assert r.text in texts[r.doc_id]


def test_units_that_share_a_digest(spark, monkeypatch):
    """Digests cut to a few bits: different units meet under one, and are told apart by the rest."""
    from xxhash import xxh3_128_digest
    words = [f"w{i}" for i in range(3000)]
    rnd = random.Random(8)
    shared = " ".join(rnd.choice(words) for _ in range(60))
    pairs = [(i, " ".join(rnd.choice(words) for _ in range(50)) + (" " + shared if i % 4 == 0 else "")) for i in range(40)]
    # the workers import the module anew, so the narrow digest is set through the mapped function
    def narrow(text, chunk_words, least_words, own=sd.units):
        starts, stops, digests = own(text, chunk_words, least_words)
        return starts, stops, [bytes([d[0] % 4]) + bytes(7) + d[8:] for d in digests]
    real = sd._units
    def units_of(rows, fields, chunk_words, least_words):
        def run(batches):
            import pyarrow as pa
            for b in batches:
                out = {f: [] for f in fields}
                for rank, h, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                    starts, stops, digests = narrow(t.encode(), chunk_words, least_words)
                    for k, (d, old) in enumerate(zip(digests, sd.again(starts, stops, digests))):
                        row = {"digest": int.from_bytes(d[:8], "little", signed=True), "rest": int.from_bytes(d[8:12], "little", signed=True),
                               "rank": rank, "text_hash": h, "place": -1 - k if old else k}
                        for f in fields:
                            out[f].append(row[f])
                kinds = {"digest": pa.int64(), "rest": pa.int32(), "rank": pa.int64(), "text_hash": pa.int64(), "place": pa.int32()}
                yield pa.RecordBatch.from_pydict({f: pa.array(v, kinds[f]) for f, v in out.items()})
        return rows.mapInArrow(run, ", ".join(f"{f} {sd._FIELDS[f]}" for f in fields))
    assert real is not units_of and xxh3_128_digest(b"x") != xxh3_128_digest(b"y")
    want = sorted(((r.doc_id, r.text) for r in sd.dedup_substrings(frame(spark, pairs)).collect()))
    monkeypatch.setattr(sd, "_units", units_of)
    assert sorted(((r.doc_id, r.text) for r in sd.dedup_substrings(frame(spark, pairs)).collect())) == want
    assert want != sorted(pairs)


def test_a_hot_digest_can_be_split(spark):
    """The join of the units with the repeated digests has a plain shuffle on either side."""
    import io
    from contextlib import redirect_stdout
    rnd = random.Random(9)
    passage = " ".join(f"h{i}" for i in range(80))
    docs = frame(spark, [(i, passage if i % 3 == 0 else prose(rnd, 60)) for i in range(60)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            sd.repeated_units(docs, repeated_ids=False).explain("simple")
        plan = out.getvalue().split("SortMergeJoin")[1].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [re.sub(r"^[\s:+\-*()0-9]+", "", x).split()[0] for x in plan[1:] if x.strip()]
    sides = " ".join(below).split("Sort")[1:3]
    assert len(sides) == 2 and all(x.split()[0] == "Exchange" for x in sides) and "HashAggregate" not in " ".join(sides)


def test_passages_over_fifty_words_stay_once(spark):
    rnd = random.Random(4)
    passages = [" ".join(f"p{k}w{rnd.randrange(400)}" for _ in range(55)) for k in range(30)]
    pairs = []
    for i in range(120):
        before = " ".join(f"d{i}w{j}" for j in range(rnd.randint(0, 40)))
        after = " ".join(f"e{i}w{j}" for j in range(rnd.randint(0, 40)))
        pairs.append((i, f"{before} {passages[i % 30]}\n{after}"))
    rows = {r.doc_id: r.text for r in sd.dedup_substrings(frame(spark, pairs)).collect()}
    for i, t in pairs:
        left = rows[i].split()
        own = [w for w in t.split() if w[0] in "de"]
        assert [w for w in left if w[0] in "de"] == own
        assert passages[i % 30] in rows[i] if i < 30 else sum(w[0] == "p" for w in left) <= 35
    assert sum(sum(w[0] == "p" for w in rows[i].split()) for i in range(30, 120)) < 90 * 16


def test_insertion_moves_few_chunks():
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(5000)}" for _ in range(2000)]
    a = set(sd.units(" ".join(words).encode())[2])
    b = set(sd.units(" ".join(words[:1000] + ["new"] + words[1000:]).encode())[2])
    assert len(a - b) < 20 and len(b - a) < 20


@pytest.mark.parametrize("text,ranges,left", [("a b  c\nd e", [(1, 3)], "a d e"), ("a b c", [(0, 3)], ""), (" a b c ", [(1, 2), (1, 3)], " a "),
                                              ("a b c d", [(2, 4)], "a b ")])
def test_cut_words(text, ranges, left):
    assert sd.cut_words(text.encode(), ranges).decode() == left


def test_texts_of_one_id_are_told_apart(spark):
    shared = " ".join(f"p{k}" for k in range(60))
    pairs = [(1, shared), (None, f"{shared} tail 6352"), (None, "short note number 173340 is all of it.")]
    docs = frame(spark, pairs)
    assert docs.where("doc_id is null").selectExpr("count(distinct hash(text))").first()[0] == 1  # equal in 32 bits
    left = sorted((r.n_cut, r.text) for r in sd.dedup_substrings(docs, count="n_cut").collect())
    assert left[:2] == [(0, shared), (0, pairs[2][1])] and left[2][0] > 40


def test_empty(spark):
    assert sd.dedup_substrings(frame(spark, awkward()).limit(0)).count() == 0
