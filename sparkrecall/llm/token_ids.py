"""Token ids of whole texts by the ``tokenizers`` library, fast enough for a corpus.

A tokenizer whose pre-tokenizer never joins text across ASCII white space gives a
text the ids of its words one after another. So each distinct word is encoded once by
the library and remembered in a bounded table keyed by 128 bits of hash; hashing the
words of a slice and looking them up is NumPy work. ``by_word=False`` encodes each text
whole instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from sparkrecall.llm.common import slices
from sparkrecall.llm.span_table import SpanTable, grown

#: Words remembered by one worker process; beyond it the table starts anew.
TABLE_WORDS = 1_000_000
_ENCODERS: dict = {}
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Letters (ASCII and Latin-1) and then marks other than the apostrophe: a pre-token each.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def id_type(path: str) -> str:
    """uint16 where the vocabulary fits, else uint32 (little-endian)."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoder(path: str, by_word: bool = True, table_words: int = TABLE_WORDS) -> Encoder:
    """The worker process's encoder of that tokenizer file."""
    key = path, by_word, table_words
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, by_word, table_words)
    return _ENCODERS[key]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letter for each byte: itself where printable, else
    one of the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(SpanTable):
    def __init__(self, path: str, by_word: bool = True, table_words: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library, self.by_word = Tokenizer.from_file(path), by_word
        self.letters, self.marks = _byte_letters(), {}
        probes = [b"a", b"the", b"walked", b"stra\xc3\x9fe", b"caf\xc3\xa9", b"end.", b"so,", b"x***", b"na\xc3\xafve!?", b"zxqv"]
        self.direct = by_word and [self._by_model(*_PLAIN.fullmatch(p).groups()) for p in probes] == self._plain(probes)
        super().__init__(table_words)

    def clear(self) -> None:
        super().clear()
        self.ids, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _plain(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def _by_model(self, letters: bytes, marks: bytes) -> list[int]:
        """A plain word by the library's model alone: it is lower case and composed, so
        normalising leaves it, and its letters and marks are one pre-token each."""
        out = [t.id for t in self.library.model.tokenize(letters.decode("latin-1").translate(self.letters))]
        if not marks:
            return out
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._plain([marks])[0]
        return out + self.marks[marks]

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        if not self.direct:
            return self._plain(words)
        plain = [_PLAIN.fullmatch(w) for w in words]
        rest = iter(self._plain([w for w, m in zip(words, plain, strict=True) if not m]))
        return [self._by_model(*m.groups()) if m else next(rest) for m in plain]

    def _learn(self, words: list[bytes], h: np.ndarray, c: np.ndarray) -> None:
        n = self.n
        found = self._encode_words(words)
        ends = self.begin[n] + np.cumsum([len(x) for x in found], dtype=np.int64)
        self.begin = grown(self.begin, n + 1, n + len(words) + 1)
        self.ids = grown(self.ids, int(self.begin[n]), int(ends[-1]))
        self.ids[self.begin[n]:ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32)
        self.begin[n + 1:n + 1 + len(words)] = ends
        self.insert(h, c)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their ends) for UTF-8 texts of a bounded slice."""
        if not self.by_word:
            found = self._plain(texts)
            return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)
        text = b"\n".join([*texts, b""])
        if self.direct and b"<|" not in text:  # the names of special tokens must stay as they are
            text = text.lower()  # A-Z alone; such a tokenizer lower-cases anyway
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(_BLANK[raw].view(np.int8), prepend=np.int8(1))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h, c = self.hashes(raw, begin, end)
        at = self.find(h, c)
        if (new := self.unknown(h, at)) is not None:
            self._learn([text[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)], h[new], c[new])
            missing = np.flatnonzero(at < 0)
            at[missing] = self.find(h[missing], c[missing])
        first = self.begin[at]
        n = self.begin[at + 1] - first
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)]
        words_before = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
        return ids, np.concatenate([[0], ends])[words_before]

    def with_end(self, texts: list[bytes], end_id: int) -> Iterator[np.ndarray]:
        """Each text's ids followed by ``end_id``; a text far beyond a slice is
        encoded in pieces that end at white space."""
        tail = np.array([end_id], np.uint32)
        for a, b in slices([len(t) for t in texts]):
            if b - a == 1 and self.by_word and len(texts[a]) > 4 << 20:
                yield np.concatenate([*(self.encode([p])[0] for p in _pieces(texts[a])), tail])
                continue
            ids, ends = self.encode(texts[a:b])
            begin = 0
            for e in ends.tolist():
                yield np.concatenate([ids[begin:e], tail])
                begin = e


def _pieces(text: bytes, most: int = 2 << 20) -> Iterator[bytes]:
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + most)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[begin:end]
        begin = end
