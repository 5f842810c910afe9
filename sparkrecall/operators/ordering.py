"""Order-preserving operators: ordered dedup, ordered cap and a distributed
global rank (list positions are semantic in the reference; Spark rows have no
order, so positions are explicit columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def text_digest(key: str) -> tuple:
    """128 bits of hash of a column, as two long columns."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), F.col(key))


def ordered_dedup(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep the first row (smallest ``order_cols``: one or two integer columns,
    together unique) of every distinct ``key``.

    A hash aggregation on the key's digest, so texts are neither sorted nor
    used as shuffle keys; map-side partial aggregation collapses copies inside
    each input partition first, so a key holding a third of all rows reaches
    the reducer as at most one row per map partition. The rows are then cut to
    the firsts by a semi join."""
    order = F.col(order_cols[0]).cast("decimal(20,0)")
    if len(order_cols) == 2:
        order = order * F.lit(1 << 32).cast("decimal(11,0)") + F.col(order_cols[1]).cast("int")
    h1, h2 = text_digest(key)
    keyed = df.select("*", h1.alias("_h1"), h2.alias("_h2"), order.cast("decimal(38,0)").alias("_ord"))
    firsts = keyed.groupBy("_h1", "_h2").agg(F.min("_ord").alias("_ord"))
    return keyed.join(firsts, ["_h1", "_h2", "_ord"], "left_semi").select(*df.columns)


def ordered_cap(df: DataFrame, n: int | None, order_cols: list[str]) -> DataFrame:
    """First ``n`` rows by ``order_cols`` (None = no cap). Spark plans this as
    TakeOrderedAndProject: every map task keeps its own top-n, one task merges."""
    if n is None:
        return df
    return df.orderBy(*order_cols).limit(int(n))


def global_rank(df: DataFrame, order_cols: list[str], out: str = "pos",
                partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row in ``order_cols`` order, computed
    without a single-partition window: range-partition and sort, number the rows of
    each partition as they are written, then add the prefix sum of the partitions'
    counts (bounded by their number). The rows are shuffled and written once."""
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_at", F.monotonically_increasing_id()))
    pid = F.shiftright("_at", 33)   # partition and row number, as Spark packs them
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long"))
            .drop("_pid", "_off", "_at"))


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], values: dict[str, object],
                 partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums per group in ``order_cols`` order.

    ``values`` maps output name -> numeric Column. A plain
    ``Window.partitionBy(group)`` would sort a group holding a third of all
    rows in one task; here rows are range-partitioned on (group, order) so a hot
    group spans many partitions, each partition sums locally, and per-group
    offsets come from a prefix sum over (partition, group) totals -- a table no
    larger than #groups + #partitions."""
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tmp = {name: f"_v_{name}" for name in values}
    base = df.select("*", *[F.coalesce(col, F.lit(0)).alias(tmp[name]) for name, col in values.items()])
    ranged = cut_lineage(base.repartitionByRange(p, *group_cols, *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    w_local = (Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(tmp[n]).over(w_local).alias(f"_l_{n}") for n in values])
    totals = ranged.groupBy("_pid", *group_cols).agg(*[F.sum(tmp[n]).alias(f"_t_{n}") for n in values])
    w_off = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group_cols,
                            *[F.coalesce(F.sum(f"_t_{n}").over(w_off), F.lit(0)).alias(f"_o_{n}") for n in values])
    offsets = offsets.withColumnsRenamed({c: f"_g_{c}" for c in ["_pid", *group_cols]})
    same = F.lit(True)
    for c in ["_pid", *group_cols]:  # null-safe: rows of a null group are a group
        same = same & local[c].eqNullSafe(offsets[f"_g_{c}"])
    out = local.join(offsets, same)
    for n in values:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_o_{n}"))
    drop = ["_pid"] + [f"_g_{c}" for c in ["_pid", *group_cols]] + [f"_l_{n}" for n in values] + [f"_o_{n}" for n in values] + list(tmp.values())
    return out.drop(*drop)
