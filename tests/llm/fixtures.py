"""Small tables for the training-data operators, and brute-force versions in plain Python."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _rank int, kept boolean"
WORDS = [a + b for a in "ba de gu ki lo ma ne po ru si to vu".split() for b in ("n", "rt", "shel", "d", "ming", "a")]


def prose(rnd, n, line=12):
    words = [rnd.choice(WORDS) for _ in range(n)]
    lines = [" ".join(words[i:i + line]).capitalize() + "." for i in range(0, n, line)]
    return "\n".join(lines)


def frame(spark, texts, parts=3):
    """(doc_id, text) pairs as documents with clashing extra columns."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 1, True) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(seed=5):
    """Nulls, empty and long texts, ties, repeated rows, odd white space, and one group
    of copies that holds a third of all rows."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(1, 150)) for _ in range(60)]
    texts += [None, None, "", " \t\n", "a", "a b", "a b c", "\x0b", "é ü x", "▁ b ▁▁", "\x00\x01", "日本語 のテキスト", "x" * 5000]
    texts += [prose(rnd, 4000)] + [t.replace(" ", "\t \r", 3) for t in texts[:10]]
    texts += ["copy of one text that many rows hold, word for word and so on."] * (len(texts) // 2)
    pairs = list(zip(rnd.sample(range(10_000), len(texts)), texts))
    pairs += [pairs[3], pairs[3], (None, texts[4]), (None, texts[4]), (None, None), (pairs[7][0], "another text with that id")]
    rnd.shuffle(pairs)
    return pairs


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)
