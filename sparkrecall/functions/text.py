"""Text column expressions (all JVM-side, codegen-friendly).

Python's ``str.split()`` / ``str.strip()`` / ``\\s`` / ``\\w`` are Unicode-aware while
Java's defaults are ASCII; the character classes below spell out the Unicode
sets explicitly so Spark (Java regex) and DuckDB (RE2) agree character for
character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the semantics being matched)
# ---------------------------------------------------------------------------
# Whitespace as Python's str.split()/str.strip()/str.isspace() define it:
# U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same set as literal characters, split into the ASCII part and the rest.
_ASCII_WS = "\t\n\x0b\x0c\r "
_OTHER_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")
WS_LITERAL = _ASCII_WS + _OTHER_WS
ASCII_WS_RUN = r"[\t\n\x0B\f\r ]+"
# Characters removed by answer normalisation: not a (Unicode) word character and
# not whitespace.  Word character = letter, number or underscore.
_NON_WORD_ASCII_WS = r"[^\p{L}\p{N}_\t\n\x0B\f\r ]"
# Articles dropped by answer normalisation.
ARTICLES = ("a", "an", "the")
# Chunking defaults: words per chunk and overlap.
CHUNK_WORDS = 120
OVERLAP_WORDS = 30
# Minimum document length in characters.
MIN_TEXT_LEN = 20
# Prompt snippet limit and the suffix appended when cutting.
SNIPPET_LIMIT = 800
ELLIPSIS = "..."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_ws(c) -> Column:
    """Map every non-ASCII whitespace character to a space (a per-character
    ``translate``, far cheaper than a Unicode regex class in Java)."""
    return F.translate(_c(c), _OTHER_WS, " " * len(_OTHER_WS))


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace; null -> ''."""
    return F.trim(F.coalesce(_c(c), F.lit("")), F.lit(WS_LITERAL))


def py_rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(WS_LITERAL))


def py_split(c) -> Column:
    """``str.split()`` with no argument: Unicode-whitespace runs, no empty items."""
    return F.filter(F.split(ascii_ws(c), ASCII_WS_RUN), lambda x: x != F.lit(""))


def bm25_tokens(c) -> Column:
    """Sparse-index tokens: ``text.lower().split()`` (punctuation kept)."""
    return py_split(F.lower(_c(c)))


def normalize_answer(c) -> Column:
    """Answer normalisation: null -> ''; lower; non-word characters -> space;
    drop the articles; collapse whitespace to single spaces."""
    cleaned = F.regexp_replace(ascii_ws(F.lower(F.coalesce(_c(c), F.lit("")))), _NON_WORD_ASCII_WS, " ")
    toks = F.filter(F.split(cleaned, ASCII_WS_RUN),
                    lambda x: (x != F.lit("")) & ~x.isin(*ARTICLES))
    return F.array_join(toks, " ")


def normalized_tokens(c) -> Column:
    """Tokens of the normalised answer (split on single spaces)."""
    n = normalize_answer(c)
    return F.filter(F.split(n, " "), lambda x: x != F.lit(""))


def truncate_text(c, limit: int = SNIPPET_LIMIT) -> Column:
    """Strip; if longer than ``limit`` keep ``limit-3`` characters, right-strip,
    then append '...'."""
    s = py_strip(c)
    cut = F.concat(py_rstrip(F.substring(s, 1, limit - len(ELLIPSIS))), F.lit(ELLIPSIS))
    return F.when(F.char_length(s) <= limit, s).otherwise(cut)


def count_alnum(c) -> Column:
    return F.char_length(F.regexp_replace(_c(c), r"[^\p{L}\p{N}]", ""))


def is_valid_query(c) -> Column:
    """Trimmed text with at least 3 letters/digits and at least one letter."""
    s = py_strip(c)
    return (F.char_length(s) > 0) & (count_alnum(s) >= 3) & s.rlike(r"\p{L}")


def has_alnum(c) -> Column:
    """Router guard: the trimmed query has at least one letter or digit."""
    return count_alnum(py_strip(c)) >= 1


def chunk_windows(c, chunk_words: int = CHUNK_WORDS, overlap_words: int = OVERLAP_WORDS,
                  words=None) -> Column:
    """Array of chunks of one text: texts of at most ``chunk_words`` words are kept
    unchanged (whitespace included); longer texts become windows of
    ``chunk_words`` words stepping by ``max(1, chunk_words-overlap_words)``,
    joined by one space, the last window ending at the final word.

    Pass ``words`` as a column *reference* (an already projected ``py_split``):
    an expression captured by the lambda would be re-evaluated per window."""
    step = max(1, chunk_words - overlap_words)
    words = py_split(c) if words is None else _c(words)
    n = F.size(words)
    last = F.ceil((n - F.lit(chunk_words)) / F.lit(step)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(words, i * step + 1, chunk_words), " "))
    return F.when(n <= chunk_words, F.array(_c(c))).otherwise(windows)
