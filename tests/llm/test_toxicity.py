import random
import zlib

import numpy as np
from fixtures import awkward, frame, prose

from sparkrecall.llm import label_model, queries, toxicity

SF001 = "/root/testdata/sf0.01"


def corpus(seed=1, n=400):
    """Documents of which a third hold words that begin with an invented stem or plain
    insults; one toxic text is copied often, so its own words look like signs."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t, toxic = prose(rnd, rnd.randint(30, 120)).split(), i % 3 == 0
        if toxic:
            for _ in range(5):
                word = "qulow" + rnd.choice(["ei", "an", "ust", "or", "ilm"]) if i % 2 else rnd.choice(["idiot", "scum", "pathetic", "moron"])
                t.insert(rnd.randrange(len(t)), word)
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    copied = docs[0][1]
    docs += [(1000 + i, copied + f" copy {i}") for i in range(30)]
    labels += [(1000 + i, 1) for i in range(30)]
    return docs, labels


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    got = toxicity.score_documents(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    true = dict(labels)
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == true[r.doc_id] for r in out) >= 0.97 * len(out) and len(out) > 50
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(2, 200)
    other = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_documents(frame(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect())
            for x in (labels, other))
    assert a == b


def test_awkward_rows(spark):
    pairs = awkward() + [(77777, "you are such a worthless idiot, a pathetic moron and a disgusting scum")]
    labels = [(i, 0) for i, _ in pairs[:40]] + [(None, 1), (pairs[0][0], None), (pairs[1][0], 1), (-5, 1)]
    got = toxicity.score_documents(frame(spark, pairs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in pairs)
    assert all(r.held_out == held(r.doc_id) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(frame(spark, pairs).limit(0), none).count() == 0
    alone = {r.doc_id: r for r in toxicity.score_documents(frame(spark, pairs), none).collect()}   # no labels: votes alone
    assert alone[77777].score > max(r.score for i, r in alone.items() if i != 77777)


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 50)
    text = prose(random.Random(3), 400) + " " + "y" * 120 + " Scum"
    assert toxicity.word_set(text) >= {"scum"} | {w.lower() for w in text.replace(".", "").split() if len(w) < 50}
    voting = toxicity.Voting(toxicity.Terms(("=scum", "^^abcd"), (True, True)))
    mask, numbers = voting.vote("x " * 10_000 + "scum abcde abcdf abcdg")
    assert numbers == [0, 1] and mask >> toxicity.VOTERS.index("mined_repeated_head") & 1
    assert voting.vote("") == (1 << toxicity.NOTHING, []) and voting.vote("You are a complete idiot")[0] >> 4 & 1


def test_label_model_finds_accuracies_and_groups():
    rnd = np.random.default_rng(0)
    y = rnd.random(40_000) < 0.2
    fire = [rnd.random(len(y)) < np.where(y, hit, miss) for hit, miss in ((0.8, 0.02), (0.7, 0.01), (0.6, 0.1))]
    fire.append(np.where(rnd.random(len(y)) < 0.9, fire[2], rnd.random(len(y)) < 0.3))   # mostly repeats its neighbour
    fire.append(~y & (rnd.random(len(y)) < 0.9))
    masks = sum(f.astype(np.int64) << v for v, f in enumerate(fire))
    given = np.where(rnd.random(len(y)) < 0.05, y.astype(np.int64), -1)
    keys, counts = np.unique(np.stack([masks, given]), axis=1, return_counts=True)
    model = label_model.fit(keys[0], keys[1], counts, [0, 1, 2, 3], [4])
    assert [2, 3] in model.groups and abs(model.share - 0.2) < 0.02
    true = [float(y[f].mean()) for f in fire]
    assert np.abs(model.accuracies(5) - true).max() < 0.05
    p = model.posterior(masks)
    assert (((p > 0.5) == y).mean()) > 0.97


def test_whole_table(spark):
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, SF001).collect()}
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert set(got) == set(table)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    english = [i for i, y in labels.items() if held(i) and y and set(table[i].lower().split()) & set(toxicity.INSULTS + toxicity.CONTEMPT)]
    assert english and all(got[i].predicted for i in english)
    clean = [i for i, y in labels.items() if held(i) and not y]
    assert sum(got[i].predicted for i in clean) <= 0.02 * len(clean)
