"""Session helpers: building a local session for tests/bench and resolving the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sparkrecall",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SPARKRECALL_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder. On a cluster this is ``spark.checkpoint.dir``
    (a shared folder); only when it is unset (local tests) a scratch folder is made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sparkrecall-ckpt-", dir=os.environ.get("SPARKRECALL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: lineage is cut, the data survives executor loss, and later
    scans are columnar (pruned, vectorised) unlike RDD checkpoint files."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, taken while they are written."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get.get("n", 0)


def bucketed_table(df: DataFrame, key: str, buckets: int | None = None, prefix: str = "sr") -> DataFrame:
    """Materialise ``df`` as a parquet table bucketed (and sorted) by ``key``
    under the shared checkpoint folder. Later joins/aggregations on ``key``
    read it without a shuffle (the scan reports the bucket partitioning)."""
    import uuid
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = ensure_checkpoint_dir(spark)
    name = f"{prefix}_{uuid.uuid4().hex}"
    (df.write.bucketBy(n, key).sortBy(key).format("parquet")
     .option("path", f"{base.rstrip('/')}/tables/{name}").saveAsTable(name))
    return spark.table(name)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input that has fewer splits than the cluster has cores
    (e.g. one parquet row group) before CPU-heavy per-row work. Inputs that
    already have enough splits -- any large table -- are left untouched."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkrecall`` importable in Python workers of a local session that
    was not started from the repository (driver harnesses, notebooks). On a
    cluster the package is shipped with ``--py-files`` / ``spark.submit.pyFiles``."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED or not sc.master.startswith("local"):
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sparkrecall-pkg-", dir=os.environ.get("SPARKRECALL_SCRATCH", "/tmp"))
    archive = shutil.make_archive(os.path.join(out, "sparkrecall"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="sparkrecall")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
