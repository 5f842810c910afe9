"""The hashing provider holds a bounded number of tokens, whatever the vocabulary."""

import numpy as np
import pandas as pd

from sparkrecall.functions import embed as E


def plain(text, dim=E.HASH_DIM):
    v = np.zeros(dim)
    for t in (text or "").lower().split():
        bucket, sign = E._token_slot(t, dim)
        v[bucket] += sign
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def test_vectors_with_a_cache_smaller_than_the_vocabulary(monkeypatch):
    monkeypatch.setattr(E, "TOKEN_CACHE", 7)
    monkeypatch.setattr(E, "SLICE_TEXTS", 3)
    texts = [None, "", "   ", *[" ".join(f"W{(i * j) % 41} x{i}" for j in range(i)) for i in range(20)]]
    out = pd.concat(E.hashing_provider()(iter([pd.Series(texts[:9], dtype=object), pd.Series(texts[9:], dtype=object)])))
    assert all(np.allclose(a, plain(t), atol=1e-15) for a, t in zip(out, texts)) and len(out) == len(texts)


def test_slots_are_bounded(monkeypatch):
    monkeypatch.setattr(E, "TOKEN_CACHE", 50)
    slots = E._Slots(64)
    most = 0
    for i in range(500):
        slots[f"t{i}"]
        most = max(most, len(slots))
    assert most == 50
