"""The binary Golay code of length 23 as a fuzzy hash.

The code is perfect: each 23-bit word is within distance 3 of exactly one of 4096
codewords. A word's keys are the indices of all codewords within distance 4: the
nearest one, and where that is 3 away, five more. Two words at distance 2 or less
have a word between them within 1 of both; its nearest codeword is within 4 of both,
so they share a key."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK_BITS = 23, 11
KEYS = 6


def remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit message; and for each syndrome what to xor to a
    word's message bits for its keys (-1: no further key)."""
    message = np.array([remainder(m << CHECK_BITS) for m in range(1 << (BITS - CHECK_BITS))], np.int64)
    heavy: dict[int, list[int]] = {}  # codewords of weight 7 by three of their bits
    for m, r in enumerate(message.tolist()):
        word = m << CHECK_BITS | r
        if word.bit_count() == 7:
            for bits in combinations([i for i in range(BITS) if word >> i & 1], 3):
                heavy.setdefault(sum(1 << i for i in bits), []).append(m)
    offsets = np.full((1 << CHECK_BITS, KEYS), -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(BITS), weight):
            error = sum(1 << i for i in bits)
            own = error >> CHECK_BITS
            keys = [own, *(own ^ m for m in heavy[error])] if weight == 3 else [own]
            offsets[remainder(error), :len(keys)] = keys
    return message, offsets


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Rows of up to six codeword indices (-1: none) for 23-bit words."""
    message, offsets = tables()
    high = words >> CHECK_BITS
    found = offsets[message[high] ^ (words & ((1 << CHECK_BITS) - 1))]
    return np.where(found < 0, -1, high[:, None] ^ found)
