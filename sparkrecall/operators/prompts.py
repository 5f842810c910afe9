"""Prompt assembly as column expressions: snippet truncation, a character
budget over the first documents, and the two prompt templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_LIMIT, truncate_text

# Document and character budgets of the prompt context.
MAX_DOCS = 2
MAX_CONTEXT_CHARS = 1400

# The two prompt templates ({context}, {past_answer}, {query}).
TEMPLATE_WITH_PAST = """
    You are a helpful AI assistant. Answer using the provided context only.
    Return the shortest correct answer phrase.

Context:
{context}

Previous Answer:
{past_answer}

Question:
{query}

If the context contains the answer, use it. If not, say you don't have enough information.

Answer:
"""

TEMPLATE_PLAIN = """
    You are a helpful AI assistant. Answer using the provided context only.
    Return the shortest correct answer phrase.

Context:
{context}

Question:
{query}

If the context contains the answer, use it. If not, say you don't have enough information.

Answer:
"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prompt_context(docs, max_docs: int = MAX_DOCS, max_context_chars: int = MAX_CONTEXT_CHARS,
                   snippet_limit: int = SNIPPET_LIMIT) -> Column:
    """First ``max_docs`` documents, each truncated; empty snippets skipped;
    stop at the first snippet that would push the running length (separators
    not counted) over ``max_context_chars``, unless nothing is selected yet;
    joined by a blank line."""
    init = F.struct(F.array().cast("array<string>").alias("sel"), F.lit(0).alias("chars"),
                    F.lit(False).alias("stop"))

    def step(acc, doc):
        snip = truncate_text(doc, snippet_limit)
        nxt = acc["chars"] + F.char_length(snip)
        skip = acc["stop"] | (snip == F.lit(""))
        overflow = (F.size(acc["sel"]) > 0) & (nxt > max_context_chars)
        return (F.when(skip, acc)
                .when(overflow, F.struct(acc["sel"].alias("sel"), acc["chars"].alias("chars"),
                                         F.lit(True).alias("stop")))
                .otherwise(F.struct(F.concat(acc["sel"], F.array(snip)).alias("sel"), nxt.alias("chars"),
                                    F.lit(False).alias("stop"))))

    docs_c = F.coalesce(_c(docs), F.array().cast("array<string>"))
    return F.array_join(F.aggregate(F.slice(docs_c, 1, max_docs), init, step)["sel"], "\n\n")


def _render(template: str, **cols: Column) -> Column:
    parts, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(pre), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def build_prompt(query, docs, past_answer=None, max_docs: int = MAX_DOCS,
                 max_context_chars: int = MAX_CONTEXT_CHARS) -> Column:
    """The prompt text; the template with the previous answer is used when it
    is a non-empty string."""
    ctx = prompt_context(docs, max_docs, max_context_chars)
    q = _c(query)
    plain = _render(TEMPLATE_PLAIN, context=ctx, query=q)
    if past_answer is None:
        return plain
    past = _c(past_answer)
    return F.when(F.coalesce(past, F.lit("")) != "",
                  _render(TEMPLATE_WITH_PAST, context=ctx, past_answer=past, query=q)).otherwise(plain)
