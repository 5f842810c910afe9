"""Embedding whitening on a weighted multiplicity covariance.

Vectors become whole-number vectors x; rows with the same x are grouped first (with
map-side partial aggregation, so a vector that a third of all rows share is one row
after the shuffle). The fit reads each distinct x once, weighted by its number of
copies or by one: sums, then a centred GEMM whose per-task d x d partial products are
added up row by row on the executors. Only the d x d covariance reaches the driver,
which takes its eigenvectors. Each distinct x is whitened once, in a written table
that the rows join, so Spark can split the rows of a hot vector.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry
are dropped. Vectors must share one length; where they don't, the length that most
rows have (of ties the shorter) is used and other rows are dropped. Entries beyond
+-2^40 after scaling are held to that. Ties and repeated rows are whitened alike, one
result row for each; a null id stays null; other columns are not read. Components
whose eigenvalue is not above 1e-12 of the trace (fewer distinct vectors than
components, constant dimensions) give no rows; an empty table gives none either.
A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.session import cut_lineage

#: Largest magnitude of a scaled entry.
HELD = float(1 << 40)
#: Eigenvalues up to this share of the trace count as zero.
ZERO_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted model; everything in it is bounded by the dimension."""
    n: int                    # total weight of the fit list
    sums: tuple[int, ...]     # per-dimension weighted sums, exact
    components: np.ndarray    # dimension x components, unit columns
    eigenvalues: np.ndarray   # falling
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole-number part and a rest below one, so that nothing is
        lost to the offset when it is subtracted."""
        whole = [round(Fraction(s, self.n)) for s in self.sums]
        return (np.array(whole, np.int64),
                np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole, strict=True)]))


def whole_vector(vec: Column, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of every entry, as array<long>."""
    return F.transform(vec, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(scale), F.lit(HELD)), F.lit(-HELD)))
                       + F.lit(offset).cast("long"))


def whole_rows(rows: DataFrame, id_col: str, vec: str, scale: int, offset: int) -> DataFrame:
    """(id, key, x) of the rows that have a usable vector; key is a hash of x."""
    v = rows[vec]
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    return (usable.select(rows[id_col].alias("id"), whole_vector(v, scale, offset).alias("x"))
            .select("id", F.xxhash64("x").alias("key"), "x"))


def distinct_vectors(whole: DataFrame) -> DataFrame:
    """Written table (key, x, copies) of the distinct vectors of the common length."""
    out = cut_lineage(whole.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies")))
    length = out.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "d").first()
    return out.where(F.size("x") == (length.d if length else 0))


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    if float(np.abs(x).max()) * float(w.sum()) < 2**62:
        return [int(v) for v in w @ x]
    return [int(v) for v in w.astype(object) @ x.astype(object)]


def weighted_sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """(total weight, exact per-dimension sums) of (x array<long>, w long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, None
        for b in batches:
            if b.num_rows:
                w = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                part = _exact_sums(_matrix(b.column(0), np.int64), w)
                total, sums = total + int(w.sum()), part if sums is None else [p + q for p, q in zip(sums, part, strict=True)]
        if sums is not None:
            values = pa.array([Decimal(v) for v in [total, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), values], names=["dim", "s"])

    found = (vectors.select("x", "w").mapInArrow(run, "dim int, s decimal(38,0)")
             .groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("dim").collect())  # dimension + 1 rows
    return (int(found[0].s), tuple(int(r.s) for r in found[1:])) if found else (0, ())


def centred_products(vectors: DataFrame, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sum of w (x - c)(x - c)' over (x array, w long), with c = whole + rest. Each task
    adds its batches up and sends d rows, which meet by their row number."""
    spark, d = vectors.sparkSession, len(whole)
    centre = spark.sparkContext.broadcast((whole, rest))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, r = centre.value
        total = np.zeros((len(a), len(a)))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), a.dtype) - a - r
                total += (x * b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]).T @ x
        yield rows_of(range(len(a)), total)

    def rows_of(at, values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())],
                                          names=["i", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}   # at most d rows of d numbers
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held[i] + np.frombuffer(part) if i in held else np.frombuffer(part)
        if held:
            yield rows_of(list(held), list(held.values()))

    parts = vectors.select("x", "w").mapInArrow(products, "i int, part binary")
    out = np.zeros((d, d))
    for r in parts.repartition(F.col("i")).mapInArrow(add, "i int, part binary").collect():  # d rows
        out[r.i] = np.frombuffer(r.part)
    return out


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The model of (x array<long>, w long) rows; None without rows."""
    n, sums = weighted_sums(vectors)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    cov = centred_products(vectors, *model.centre()) / n
    values, columns = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > ZERO_SHARE * max(np.trace(cov), 0.0)]
    columns = columns[:, order]
    if len(order):  # either sign will do; the largest entry is made positive
        columns = columns * np.sign(columns[np.abs(columns).argmax(0), np.arange(len(order))])
    return Whitening(n, sums, columns, values[order], float(np.trace(cov)))


def _deviation(x: np.ndarray, model: Whitening, whole: np.ndarray) -> list[int | None]:
    rest = np.array([s - model.n * int(a) for s, a in zip(model.sums, whole, strict=True)], dtype=object)
    far = x - whole
    if (float(np.abs(far).max()) * model.n + float(max(abs(r) for r in rest))) ** 2 * len(whole) < 2**62:
        v = model.n * far - rest.astype(np.int64)
        return [int(t) for t in (v * v).sum(1)]
    v = model.n * far.astype(object) - rest
    return [t if t < 2**63 else None for t in (v * v).sum(1)]


def whiten_distinct(distinct: DataFrame, model: Whitening) -> DataFrame:
    """Written table (key, x, copies, deviation, whitened array<double>)."""
    held = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        whole, rest = m.centre()
        turn = m.components / np.sqrt(m.eigenvalues)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(b.schema.get_field_index("x")), np.int64)
            y = (x - whole - rest) @ turn
            ends = pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(_deviation(x, m, whole), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))],
                names=[*b.schema.names, "deviation", "whitened"])

    return cut_lineage(distinct.select("key", "x", "copies").mapInArrow(
        run, "key long, x array<long>, copies long, deviation long, whitened array<double>"))


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of (x array<double>, w long) minus the identity."""
    if not components:
        return 0.0
    sums = whitened.agg(*[F.sum(F.col("x")[i] * F.col("w")) for i in range(components)]).first()
    cov = centred_products(whitened, np.zeros(components), np.array([s / n for s in sums])) / n
    return float(np.abs(cov - np.eye(components)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000, weigh_copies: bool = False) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per
    usable row and component. A fit weight is the number of a vector's copies with
    ``weigh_copies``, else one."""
    whole = whole_rows(rows, id_col, vec, scale, offset)
    distinct = distinct_vectors(whole)
    weight = F.col("copies") if weigh_copies else F.lit(1).cast("long")
    model = fit(distinct.select("x", weight.alias("w")), components)
    kind = rows.schema[id_col].dataType.simpleString()
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame(
            [], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    once = whiten_distinct(distinct, model)
    error = identity_error(once.select(F.col("whitened").alias("x"), weight.alias("w")), model.n, len(model.eigenvalues))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return (whole.join(once, ["key", "x"]).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))
