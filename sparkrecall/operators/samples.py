"""Nested QA samples -> evidence texts, gold answers, ids and question sets.

``flatten_text`` is built from the column's Spark type at plan time: a tree of
``concat`` / ``flatten`` / ``transform`` expressions, so nested evidence of any
(typed) shape is flattened inside the JVM, one row at a time, without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from .ordering import ordered_cap

# Struct keys read first (in this order) when flattening, and the
# evidence-like sample fields (in this order).
PREFERRED_KEYS = ("text", "sentence", "content", "description", "title", "passage")
EVIDENCE_FIELDS = ("evidence", "entity_pages", "search_results", "web_pages", "context")
# Id formats and the placeholder corpus of the smoke runner.
ID_FORMAT = "triviaqa_%05d"
WIKI_ID_FORMAT = "triviaqa_wiki_%04d"
SYNTHETIC_ID_FORMAT = "synthetic_%03d"
PLACEHOLDER_DOC = "Document %d: Context about general knowledge"
PLACEHOLDER_COUNT = 20
PLACEHOLDER_MIN_DOCS = 10

def _empty() -> Column:
    return F.array().cast("array<string>")


def _is_container(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.ArrayType, T.MapType))


def flatten_text(col: Column, dtype: T.DataType) -> Column:
    """array<string> of trimmed non-empty texts, in the order a recursive walk
    yields them: a string yields itself; a struct yields its preferred keys
    first (in the fixed order), then every container-valued field again in
    field order; an array yields its items; other values yield nothing."""
    if isinstance(dtype, T.StringType):
        s = py_strip(col)
        return F.when(col.isNotNull() & (s != ""), F.array(s)).otherwise(_empty())
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        return F.coalesce(F.flatten(F.transform(col, lambda x: flatten_text(x, inner))), _empty())
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType
        return F.coalesce(F.flatten(F.transform(F.map_values(col), lambda x: flatten_text(x, vt))), _empty())
    if isinstance(dtype, T.StructType):
        names = {f.name: f for f in dtype.fields}
        parts = [flatten_text(col.getField(k), names[k].dataType) for k in PREFERRED_KEYS if k in names]
        parts += [flatten_text(col.getField(f.name), f.dataType) for f in dtype.fields if _is_container(f.dataType)]
        if not parts:
            return _empty()
        return F.when(col.isNotNull(), F.concat(*parts)).otherwise(_empty())
    return _empty()


def _item_no(j: Column) -> Column:
    return F.when(j < 1 << 28, j).otherwise(F.raise_error(F.lit("too many texts in one field for the order key")).cast("int"))


def _sample_no(p: Column) -> Column:
    return F.when(p.between(0, (1 << 31) - 1), p).otherwise(
        F.raise_error(F.lit("sample position beyond the order key")).cast("long"))


def explode_evidence(samples: DataFrame, pos: str = "pos", fields=EVIDENCE_FIELDS) -> DataFrame:
    """(pos, text) for every evidence text of every sample, with a packed long
    order key: sample position, field number, item number."""
    def keyed(field_no):
        return lambda t, j: F.struct((F.lit(field_no) * (1 << 28) + _item_no(j)).alias("k"), t.alias("text"))

    parts = []
    for i, name in enumerate(fields):
        if name not in samples.columns:
            continue
        dtype = samples.schema[name].dataType
        parts.append(F.transform(flatten_text(F.col(name), dtype), keyed(i)))
    if not parts:
        return samples.sparkSession.createDataFrame([], "pos long, text string")
    x = samples.select(F.col(pos).cast("long").alias("_p"), F.explode(F.concat(*parts)).alias("x"))
    return x.select((_sample_no(F.col("_p")) * (1 << 32) + F.col("x.k")).alias("pos"), F.col("x.text").alias("text"))


def smoke_evidence(samples: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, text) from ``evidence.wikipedia[]``: a struct item gives its
    ``text``, a string item itself; empty texts dropped (no trimming)."""
    wiki = samples.schema["evidence"].dataType["wikipedia"].dataType.elementType
    item = (lambda x: x.getField("text")) if isinstance(wiki, T.StructType) else (lambda x: x.cast("string"))
    x = samples.select(F.col(pos).cast("long").alias("_p"), F.posexplode("evidence.wikipedia").alias("j", "it"))
    t = item(F.col("it"))
    return (x.filter(t.isNotNull() & (t != ""))
            .select((_sample_no(F.col("_p")) * (1 << 32) + F.col("j")).alias("pos"), t.alias("text")))


def smoke_corpus(samples: DataFrame, pos: str = "pos") -> DataFrame:
    """Unique evidence texts (first occurrence kept) as (pos, text); fewer than
    10 -> the fixed placeholder corpus instead (decided by a scalar subquery)."""
    from .ordering import ordered_dedup
    docs = ordered_dedup(smoke_evidence(samples, pos), "text", ["pos"])
    n = docs.agg(F.count(F.lit(1))).scalar()
    ph = (samples.sparkSession.range(PLACEHOLDER_COUNT)
          .select(F.col("id").alias("pos"), F.format_string(PLACEHOLDER_DOC, F.col("id").cast("int")).alias("text")))
    return docs.filter(n >= PLACEHOLDER_MIN_DOCS).unionByName(ph.filter(n < PLACEHOLDER_MIN_DOCS))


# ---------------------------------------------------------------------------
# Gold answers and ids
# ---------------------------------------------------------------------------
def _answer_parts(samples: DataFrame, answer: str = "answer"):
    """(value, text, aliases) columns whether ``answer`` is a struct or a string."""
    dt = samples.schema[answer].dataType
    if isinstance(dt, T.StructType):
        names = set(dt.fieldNames())
        get = lambda k, default: F.col(f"{answer}.{k}") if k in names else default
        return (get("value", F.lit(None).cast("string")), get("text", F.lit(None).cast("string")),
                get("aliases", F.lit(None).cast("array<string>")), F.lit(True))
    s = F.col(answer).cast("string")
    return s, F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(False)


def extract_answers(samples: DataFrame, variant: str = "default", answer: str = "answer") -> DataFrame:
    """Adds answer_value and answer_aliases.

    default: value = answer.value ('' if missing); the value is put first
      unless already an alias; blank aliases dropped; none left -> [value] or [].
    fallback_text: value = answer.value or answer.text or ''; otherwise as default.
    as_given: aliases exactly as stored (the value is not added); a bare string
      answer gives [answer]."""
    value, text, aliases, is_struct = _answer_parts(samples, answer)
    if variant == "as_given":
        v = F.coalesce(value, F.lit(""))
        al = F.when(is_struct, F.coalesce(aliases, _empty())).otherwise(F.array(value))
        return samples.withColumn("answer_value", v).withColumn("answer_aliases", al)
    if variant == "fallback_text":
        v = F.coalesce(F.nullif(value, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))
    else:
        v = F.coalesce(value, F.lit(""))
    al = F.coalesce(aliases, _empty())
    present = F.coalesce(F.exists(al, lambda a: a == v), F.lit(False))
    al2 = F.when((v != "") & ~present, F.concat(F.array(v), al)).otherwise(al)
    al3 = F.filter(al2, lambda a: a.isNotNull() & (py_strip(a) != ""))
    final = F.when(F.size(al3) > 0, al3).when(v != "", F.array(v)).otherwise(_empty())
    return samples.withColumn("answer_value", v).withColumn("answer_aliases", final)


def sample_id(samples: DataFrame, pos: str = "pos", variant: str = "default") -> Column:
    """First non-empty of question_id, qid, id, else ``triviaqa_%05d`` of the pool
    position. variant 'last_passes': the last id passes even when empty (only a
    missing one falls back)."""
    ids = [F.col(c).cast("string") for c in ("question_id", "qid", "id") if c in samples.columns]
    fb = F.format_string(ID_FORMAT, F.col(pos).cast("int"))
    if not ids:
        return fb
    if variant == "last_passes":
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in ids[:-1]], ids[-1], fb)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ids], fb)


def positional_id(pos: str = "pos", fmt: str = WIKI_ID_FORMAT) -> Column:
    return F.format_string(fmt, F.col(pos).cast("int"))


def select_questions(samples: DataFrame, n: int | None, pos: str = "pos", variant: str = "default",
                     id_variant: str = "default") -> DataFrame:
    """Evaluation set: trimmed question, non-empty question and answer value,
    the first ``n`` valid rows in pool order; ids use the pool position."""
    s = extract_answers(samples, variant).withColumn("question", py_strip("question"))
    s = s.withColumn("query_id", sample_id(samples, pos, id_variant))
    s = s.filter((F.col("question") != "") & (F.col("answer_value") != ""))
    return ordered_cap(s.select(pos, "query_id", "question", "answer_value", "answer_aliases"), n, [pos])
