"""The persisted index: reuse, append, compaction, lost runs, failed writes."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.operators import vector_index as V


@pytest.fixture(scope="module")
def memory(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rnd.normal(size=6)] if i % 13 else [0.0] * 6, f"r{i % 3}") for i in range(150)]
    return spark.createDataFrame(rows, "id long, query_embedding array<double>, run_id string"), rows


def brute(rows, queries, k=2):
    out = set()
    held = [(i, np.array(v) / np.linalg.norm(v)) for i, v, _ in rows if np.linalg.norm(v) > 0]
    for i, v in queries:
        u = np.array(v) / np.linalg.norm(v)
        best = sorted((-round(float(u @ w), 9), j) for j, w in held)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(best)}
    return out


def found(index, spark, queries):
    df = spark.createDataFrame(queries, "query_id long, vec array<double>")
    return {(r.query_id, r.doc_id, r.rank) for r in index.nearest(df, 2).collect()}


def test_a_second_run_reads_the_index(spark, memory, tmp_path, monkeypatch):
    df, rows = memory
    path = str(tmp_path / "index")
    queries = [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(12)]
    first = V.load_or_rebuild(df.where("run_id != 'r2'"), path, cell_rows=20)
    assert found(first, spark, queries) == brute([r for r in rows if r[2] != "r2"], queries)
    written = []
    real = V.VectorIndex._write
    monkeypatch.setattr(V.VectorIndex, "_write", lambda self, units, run: written.append(run) or real(self, units, run))
    again = V.load_or_rebuild(df, path)
    assert written == ["r2"] and again.version() == 2      # two versions for the first runs, one more now
    assert found(again, spark, queries) == brute(rows, queries)
    V.load_or_rebuild(df, path)
    assert written == ["r2"]
    # a lost run folder is noticed and derived from the memory again
    shutil.rmtree(f"{path}/data/run_id=r1")
    spark.catalog.refreshByPath(path)
    mended = V.load_or_rebuild(df, path)
    assert written == ["r2", "r1"] and found(mended, spark, queries) == brute(rows, queries)
    # data without a snapshot (a run that failed before its commit) is not read
    V.place(V.units_of(df.select((F.col("id") + 1000).alias("id"), "query_embedding"), "id", "query_embedding"), mended.pivots).write.parquet(
        f"{path}/data/run_id=half")
    assert found(V.open_index(spark, path), spark, queries) == brute(rows, queries)
    mended.compact("all-1")
    assert [r.run_id for r in mended.snapshot().collect()] == ["all-1"] and not mended.lost_runs()
    assert found(V.open_index(spark, path), spark, queries) == brute(rows, queries)
