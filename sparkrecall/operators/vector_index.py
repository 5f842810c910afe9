"""A persisted vector index of the memory: reused by later runs, appended to per run.

``<path>/pivots`` holds the pivots, drawn when the index is made. ``<path>/data`` holds
(id, vec, cell, ring) in a folder per run: unit vectors in the cells of those pivots, so
a search starts without a pass over the vectors. ``<path>/snapshots`` holds one table
per version: the runs that belong to it and their numbers of rows. A version is
written after its data, in one commit, and readers take the latest one, so a run that
failed half-way is not seen, and older versions stay readable until they are vacuumed
by the user.

``load_or_rebuild`` compares the rows on disk with the snapshot's numbers; runs that
lack some are derived again from the memory table and written as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_normalize
from .knn import _stack
from .pivots import CELL_ROWS, describe, draw_pivots, place, search_cells
from .topk import top_k

_DATA = "id long, vec array<double>, cell int, ring double, run_id string"


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    pivots: np.ndarray

    def snapshot(self) -> DataFrame:
        """(run_id, rows) of the latest version."""
        all_of = self.spark.read.parquet(f"{self.path}/snapshots")
        return all_of.where(F.col("version") == all_of.agg(F.max("version")).scalar()).select("run_id", "rows")

    def version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/snapshots").agg(F.max("version")).first()[0]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return -1
            raise

    def rows(self) -> DataFrame:
        """(id, vec, cell, ring, run_id) of the snapshot's runs."""
        data = self.spark.read.schema(_DATA).parquet(f"{self.path}/data")
        return data.join(F.broadcast(self.snapshot().select("run_id")), "run_id", "left_semi").select("id", "vec", "cell", "ring", "run_id")

    def _write(self, units: DataFrame, run_id: str) -> int:
        folder = f"{self.path}/data/run_id={run_id}"
        place(units, self.pivots).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder).count()

    def _commit(self, runs: DataFrame) -> None:
        runs.select("run_id", "rows").coalesce(1).write.parquet(f"{self.path}/snapshots/version={self.version() + 1}")

    def append(self, entries: DataFrame, run_id: str, mem_id: str = "id", vec: str = "query_embedding") -> None:
        """Adds a run's entries; a run appended again replaces its own rows."""
        now = self.spark.createDataFrame([(run_id, self._write(units_of(entries, mem_id, vec), run_id))], "run_id string, rows long")
        self._commit(now if self.version() < 0 else self.snapshot().where(F.col("run_id") != run_id).unionByName(now))

    def compact(self, run_id: str) -> None:
        """All runs as one run of that (new) name, in a version of its own."""
        n = self._write(self.rows().select("id", "vec"), run_id)
        self._commit(self.spark.createDataFrame([(run_id, n)], "run_id string, rows long"))

    def lost_runs(self) -> list[str]:
        """Runs of the snapshot with fewer or more rows than it says (a bounded list of names)."""
        held = self.rows().groupBy("run_id").agg(F.count(F.lit(1)).alias("held"))
        return [r.run_id for r in self.snapshot().join(held, "run_id", "left").where("coalesce(held, 0) != rows").collect()]

    def nearest(self, queries: DataFrame, k: int = 1, qid: str = "query_id", qvec: str = "vec") -> DataFrame:
        """(query_id, doc_id, similarity, rank): the k entries of highest cosine, exact;
        equal ones go to the lower id. Zero vectors are similar to nothing (0.0)."""
        placed = self.rows().drop("run_id")
        q = queries.select(F.col(qid).cast("long").alias("query_id"), l2_normalize(as_double(qvec)).alias("qv"))
        found = top_k(search_cells(q, placed, describe(placed, self.pivots), k), k, score="dist", ascending=True)
        zero = F.forall("qv", lambda x: x == 0)
        found = found.join(q.select("query_id", zero.alias("zero")), "query_id")
        # of unit vectors: |a - b|^2 = 2 - 2 cos
        return found.select("query_id", "doc_id", F.when(F.col("zero"), 0.0).otherwise(1 - F.col("dist") / 2).alias("similarity"), "rank")


def units_of(entries: DataFrame, mem_id: str, vec: str) -> DataFrame:
    """(id, vec) with a unit vector; entries without one are similar to nothing and left out."""
    u = entries.select(F.col(mem_id).cast("long").alias("id"), l2_normalize(as_double(vec)).alias("vec"))
    return u.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))


def create_index(entries: DataFrame, path: str, run_id: str, mem_id: str = "id", vec: str = "query_embedding",
                 cell_rows: int = CELL_ROWS) -> VectorIndex:
    """A new index whose pivots are drawn from the entries, which are its first run."""
    spark, units = entries.sparkSession, units_of(entries, mem_id, vec)
    pivots = draw_pivots(units, units.count(), cell_rows)
    spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "no int, vec array<double>").coalesce(1).write.parquet(
        f"{path.rstrip('/')}/pivots")
    index = VectorIndex(spark, path.rstrip("/"), pivots)
    index.append(entries, run_id, mem_id, vec)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path.rstrip('/')}/pivots").orderBy("no").collect()   # MOST_PIVOTS rows at most
    return VectorIndex(spark, path.rstrip("/"), _stack(pd.Series([r.vec for r in rows])))


def load_or_rebuild(memory: DataFrame, path: str, run_col: str = "run_id", mem_id: str = "id", vec: str = "query_embedding",
                    cell_rows: int = CELL_ROWS) -> VectorIndex:
    """The index at ``path`` for a memory table with a run column: made where there is
    none, else opened, runs that the memory has and the snapshot lacks appended, and
    damaged runs written again from the memory."""
    spark = memory.sparkSession
    runs = [r[0] for r in memory.select(F.col(run_col).cast("string")).distinct().orderBy(run_col).collect()]   # names of runs
    of = lambda run: memory.where(F.col(run_col).cast("string") == run)
    try:
        index = open_index(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if not runs:
            raise ValueError("no index and no memory to make it from") from e
        index = create_index(of(runs[0]), path, runs[0], mem_id, vec, cell_rows)
    known = {r.run_id for r in index.snapshot().collect()} - set(index.lost_runs())
    for run in runs:
        if run not in known:
            index.append(of(run), run, mem_id, vec)
    return index
