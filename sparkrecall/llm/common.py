"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrecall.session import cut_lineage

#: White space of the contracts, as a Java/RE2 character class.
WS = r"[\x20\x09-\x0D]"
#: Text handled at once inside a task; bounds the memory of token lists.
SLICE_BYTES = 2 << 20


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names starting with ``wanted`` that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        n = f"_{w}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(df[text], F.lit(""))


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, f"{WS}+", " ")


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most`` (at least one row each)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Sub-batches of bounded text with their texts as UTF-8 bytes (null: empty)."""
    at = batch.schema.get_field_index(column)
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
    for a, b in slices(sizes, most):
        part = batch.slice(a, b - a)
        yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]


def prefix_sums(df: DataFrame, order: list[str], value: str, start: str) -> DataFrame:
    """``df`` with ``start``, the sum of ``value`` over all rows before in
    ``order`` (which must be total). Range partitions are sorted and summed in
    their own tasks; only one total per partition reaches the driver, and each
    partition's base is the prefix sum of those totals. The result is a written
    table, so it can be read again without a second sort."""
    pid, local = fresh(df, "pid", "local")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        total, me = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype("int64")
            ends = total + np.cumsum(n)
            cols = [*b.columns, pa.array(np.full(len(n), me, "int32")), pa.array(ends - n)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, pid, local])
            total = int(ends[-1]) if len(n) else total

    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(local, T.LongType())])
    summed = cut_lineage(ranged.mapInArrow(run, schema))
    totals = sorted(map(tuple, summed.groupBy(pid).agg(F.sum(value)).collect()))  # one row per partition
    bases, base = [], 0
    for p, n in totals:
        bases.append((p, base))
        base += n
    base_df = df.sparkSession.createDataFrame(bases, f"{pid} int, {start} long")
    return summed.join(F.broadcast(base_df), pid).withColumn(start, F.col(start) + F.col(local)).drop(pid, local)


def drop_losers(docs: DataFrame, keyed: DataFrame, losers: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """``docs``' columns of those rows of ``keyed`` (docs with the ``keys``
    columns added) whose keys are not in ``losers``; with ``repeated``, rows that
    agree in all keys are reduced to one of them (the first of a written table of
    these rows; columns of any type, maps too, are carried along)."""
    right = losers.select(*[F.col(k).alias(f"{k}_r") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & keyed[k].eqNullSafe(right[f"{k}_r"])
    left = keyed.join(right, same, "left_anti")
    if not repeated:
        return left.select(*docs.columns)
    counts = left.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"{k}_r") for k in keys])
    once = left.join(counts, _null_safe(left, counts, keys), "left_anti").select(*docs.columns)
    [uid] = fresh(keyed, "uid")
    many = cut_lineage(left.join(counts, _null_safe(left, counts, keys), "left_semi").withColumn(uid, F.monotonically_increasing_id()))
    firsts = cut_lineage(many.groupBy(*keys).agg(F.min(uid).alias(uid)).select(uid))
    many = many.join(firsts, uid, "left_semi").select(*docs.columns)
    return once.unionByName(many)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{k}_r"])
    return cond


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of unsigned numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
