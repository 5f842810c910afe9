"""Evidence texts of untyped samples: nested JSON whose shape differs from row to row.

``samples.explode_evidence`` builds its expressions from a column's type; here the type
is in the data. Each level of nesting is one pass over the rows that are still objects
or arrays: a value is parsed twice, as raw text (which keeps the order of an object's
keys) and as VARIANT (which tells a string from an object that only looks like one).
A text's path of steps is its order key, with the preferred keys before the containers,
so sorting by path gives the order of the recursive walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage
from .samples import EVIDENCE_FIELDS, PREFERRED_KEYS, _item_no, _sample_no

_NODE = "array<struct<step:int,raw:string,kind:string>>"


def _kind(value: Column) -> Column:
    """'STRING', 'OBJECT', 'ARRAY' or another type's name (null for a missing value)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _object_children(raw: Column) -> Column:
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    keys = F.map_keys(texts)
    first = F.array(*[F.struct(F.lit(i).alias("step"), F.element_at(texts, F.lit(k)).alias("raw"),
                               _kind(F.element_at(values, F.lit(k))).alias("kind")) for i, k in enumerate(PREFERRED_KEYS)])
    fields = F.transform(keys, lambda k, i: F.struct((i + len(PREFERRED_KEYS)).cast("int").alias("step"), F.element_at(texts, k).alias("raw"),
                                                     _kind(F.element_at(values, k)).alias("kind")))
    return F.concat(F.filter(first, lambda x: x["kind"].isNotNull()), F.filter(fields, lambda x: x["kind"].isin("OBJECT", "ARRAY")))


def _array_children(raw: Column) -> Column:
    both = F.arrays_zip(F.from_json(raw, "array<string>").alias("raw"), F.from_json(raw, "array<variant>").alias("value"))
    return F.transform(both, lambda x, i: F.struct(i.cast("int").alias("step"), x["raw"].alias("raw"), _kind(x["value"]).alias("kind")))


def walk_texts(nodes: DataFrame) -> DataFrame:
    """(key columns, path array<int>, text) of all texts below the nodes (key columns,
    raw string, kind): trimmed, not empty. As many passes as the data is deep."""
    keys = [c for c in nodes.columns if c not in ("raw", "kind")]
    level = cut_lineage(nodes.withColumn("path", F.array().cast("array<int>")))
    out = None
    while True:
        texts = level.where("kind = 'STRING'").select(*keys, "path", py_strip("raw").alias("text")).where("text != ''")
        out = texts if out is None else out.unionByName(texts)
        inner = level.where("kind in ('OBJECT', 'ARRAY')")
        if inner.isEmpty():
            return out
        children = F.when(F.col("kind") == "OBJECT", _object_children(F.col("raw")).cast(_NODE)).otherwise(_array_children(F.col("raw")).cast(_NODE))
        level = cut_lineage(inner.select(*keys, "path", F.explode(children).alias("x"))
                            .select(*keys, F.concat("path", F.array("x.step")).alias("path"), "x.raw", "x.kind"))


def explode_untyped_evidence(samples: DataFrame, json: str, pos: str = "pos", fields=EVIDENCE_FIELDS) -> DataFrame:
    """(pos, text) as ``samples.explode_evidence`` gives them, from samples whose fields
    are one JSON object in the column ``json``; what is no JSON object has no texts."""
    texts, values = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")
    parts = F.array(*[F.struct(F.lit(i).alias("field"), F.element_at(texts, F.lit(f)).alias("raw"),
                               _kind(F.element_at(values, F.lit(f))).alias("kind")) for i, f in enumerate(fields)])
    # try_parse_json is null for text that is no JSON
    nodes = (samples.where(F.try_parse_json(F.col(json)).isNotNull()).select(F.col(pos).cast("long").alias("_p"), F.explode(parts).alias("x"))
             .select("_p", "x.field", "x.raw", "x.kind").where("kind is not null"))
    w = Window.partitionBy("_p", "field").orderBy("path")
    found = walk_texts(nodes).withColumn("_j", F.row_number().over(w) - 1)
    return found.select((_sample_no(F.col("_p")) * (1 << 32) + F.col("field") * (1 << 28) + _item_no(F.col("_j"))).alias("pos"), "text")
