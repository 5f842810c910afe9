"""Overlapping word-window chunking as a generator over a column (posexplode)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK_WORDS, OVERLAP_WORDS, chunk_windows, py_split

# chunk_id = doc_pos * CHUNK_ID_STRIDE + chunk_no keeps (doc_pos, chunk_no) order in one long.
CHUNK_ID_STRIDE = 1 << 20


def chunk_id(doc_pos: str, chunk_no: str):
    """The packed id; an overrun raises instead of meeting the next document's ids."""
    fits = (F.col(chunk_no) < CHUNK_ID_STRIDE) & F.col(doc_pos).between(0, (1 << 43) - 1)
    return F.when(fits, F.col(doc_pos) * CHUNK_ID_STRIDE + F.col(chunk_no)).otherwise(
        F.raise_error(F.format_string("chunk %s of document %s has no id", F.col(chunk_no), F.col(doc_pos))).cast("long"))


def chunk_text(df: DataFrame, text_col: str = "text", chunk_words: int = CHUNK_WORDS,
               overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """One row per chunk: input columns (without ``text_col``) + ``chunk_no`` + ``text``."""
    keep = [c for c in df.columns if c != text_col]
    words = df.select(*keep, text_col, py_split(text_col).alias("_words"))
    return words.select(*keep, F.posexplode(chunk_windows(F.col(text_col), chunk_words, overlap_words,
                                                          words="_words")).alias("chunk_no", "text"))
