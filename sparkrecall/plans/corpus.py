"""Corpus build: filter -> ordered dedup -> cap -> fallback -> chunk -> ordered
chunk dedup -> cap, all as one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK_WORDS, MIN_TEXT_LEN, OVERLAP_WORDS, py_strip
from ..operators.chunking import chunk_id, chunk_text
from ..operators.ordering import global_rank, ordered_cap, ordered_dedup
from ..session import cut_and_count

# Documents below this count trigger the question fallback.
FALLBACK_MIN_DOCS = 20


@dataclass
class Corpus:
    chunks: DataFrame   # chunk_id, doc_pos, chunk_no, text
    stats: DataFrame    # documents_before_chunking, chunk_count


def build_corpus(texts: DataFrame, *, pos_col: str = "pos", text_col: str = "text",
                 questions: DataFrame | None = None, min_text_len: int = MIN_TEXT_LEN,
                 max_docs: int | None = None, max_chunks: int | None = None,
                 chunk_words: int = CHUNK_WORDS, overlap_words: int = OVERLAP_WORDS,
                 dense_positions: bool = False, chunk: bool = True,
                 question_min_len: int | None = None, write: bool = False) -> Corpus:
    """``texts`` holds candidate documents with a long order key ``pos_col``.

    ``questions`` (pos, text) are added after the documents, minus those already
    seen, when fewer than 20 unique documents survive. ``dense_positions`` renumbers
    documents 0..n-1 (needed when ``pos`` is a packed key); otherwise ``pos`` must be
    < 2**43.

    The documents are written once and counted while they are, so their texts are
    deduplicated once however often they are read on. ``write``: the chunks as well;
    without it every use of the chunks or their count runs the chunking."""
    docs = (texts.select(F.col(pos_col).cast("long").alias("pos"), py_strip(text_col).alias("text"))
            .filter((F.char_length("text") > 0) & (F.char_length("text") >= min_text_len)))
    docs, n_before = cut_and_count(ordered_cap(ordered_dedup(docs, "text", ["pos"]), max_docs, ["pos"]))
    dense_positions = dense_positions or questions is not None
    order = ["pos"]
    if questions is not None and n_before < FALLBACK_MIN_DOCS:
        qmin = min_text_len if question_min_len is None else question_min_len
        q = (questions.select(F.col(pos_col).cast("long").alias("qpos"), py_strip(text_col).alias("text"))
             .filter((F.char_length("text") > 0) & (F.char_length("text") >= qmin)))
        q = ordered_dedup(q, "text", ["qpos"]).join(docs.select("text"), "text", "left_anti")
        both = (docs.select(F.lit(0).alias("phase"), "pos", "text")
                .unionByName(q.select(F.lit(1).alias("phase"), F.col("qpos").alias("pos"), "text")))
        docs, n_before = cut_and_count(ordered_cap(both, max_docs, ["phase", "pos"]))
        order = ["phase", "pos"]
    if dense_positions:
        docs = global_rank(docs, order, out="doc_pos").select("doc_pos", "text")
    else:
        docs = docs.select(F.col("pos").alias("doc_pos"), "text")
    before = docs.sparkSession.range(1).select(F.lit(n_before).cast("long").alias("documents_before_chunking"))
    if chunk:
        chunks = chunk_text(docs, "text", chunk_words, overlap_words)
    else:
        chunks = docs.withColumn("chunk_no", F.lit(0))
    chunks = ordered_dedup(chunks.select("doc_pos", "chunk_no", "text"), "text", ["doc_pos", "chunk_no"])
    chunks = ordered_cap(chunks, max_chunks, ["doc_pos", "chunk_no"])
    chunks = chunks.select(chunk_id("doc_pos", "chunk_no").alias("chunk_id"),
                           "doc_pos", F.col("chunk_no").cast("int").alias("chunk_no"), "text")
    if write:
        chunks, n_chunks = cut_and_count(chunks)
        return Corpus(chunks, before.withColumn("chunk_count", F.lit(n_chunks).cast("long")))
    stats = before.select("documents_before_chunking",
                          chunks.agg(F.count(F.lit(1))).scalar().alias("chunk_count"))
    return Corpus(chunks, stats)


def documents_corpus(documents: DataFrame, **kw) -> Corpus:
    """The driver's ``documents`` table as a corpus: order key = doc_id."""
    return build_corpus(documents.select(F.col("doc_id").alias("pos"), "text"), **kw)


def build_corpus_from_samples(samples: DataFrame, pos: str = "pos", min_text_len: int = MIN_TEXT_LEN,
                              max_docs: int | None = None, max_chunks: int | None = None,
                              chunk_words: int = CHUNK_WORDS, overlap_words: int = OVERLAP_WORDS, write: bool = False) -> Corpus:
    """Evidence of nested QA samples -> deduplicated, chunked corpus (caps only where given);
    questions are added when fewer than 20 unique documents are found."""
    from ..operators.samples import explode_evidence
    texts = explode_evidence(samples, pos)
    questions = samples.select(F.col(pos).alias("pos"), F.col("question").cast("string").alias("text"))
    return build_corpus(texts, questions=questions, min_text_len=min_text_len, max_docs=max_docs,
                        max_chunks=max_chunks, chunk_words=chunk_words, overlap_words=overlap_words, write=write)


def build_passage_corpus(samples: DataFrame, pos: str = "pos", max_docs: int | None = None) -> Corpus:
    """Phase-2 flavour: unchunked passages; the question fallback only needs a
    non-empty question; the cap applies to the final list."""
    from ..operators.samples import explode_evidence
    texts = explode_evidence(samples, pos)
    questions = samples.select(F.col(pos).alias("pos"), F.col("question").cast("string").alias("text"))
    return build_corpus(texts, questions=questions, max_docs=max_docs, chunk=False, question_min_len=1)
