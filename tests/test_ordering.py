"""Order-preserving operators stay exact when one key holds a third of the rows."""

import random

from pyspark.sql import functions as F

from sparkrecall.operators.ordering import global_rank, ordered_cap, ordered_dedup, running_sums


def _rows(n=3000, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)      # group 0 holds a third of all rows
        out.append((i, g, rnd.random(), rnd.choice(["memory", "retrieval"])))
    rnd.shuffle(out)
    return out


def test_running_sums_hot_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "seq long, grp long, x double, source string").repartition(7)
    got = running_sums(df, ["grp"], ["seq"], {"n_mem": (F.col("source") == "memory").cast("long"),
                                               "sx": F.col("x")}, partitions=16)
    got = {r["seq"]: (r["n_mem"], r["sx"]) for r in got.collect()}
    want, acc = {}, {}
    for seq, g, x, src in sorted(rows):
        a = acc.setdefault(g, [0, 0.0])
        a[0] += src == "memory"
        a[1] += x
        want[seq] = (a[0], a[1])
    assert set(got) == set(want)
    for k, (m, s) in want.items():
        assert got[k][0] == m and abs(got[k][1] - s) < 1e-9


def test_global_rank_and_cap(spark):
    rows = _rows(1000)
    df = spark.createDataFrame(rows, "seq long, grp long, x double, source string")
    ranked = {r["seq"]: r["pos"] for r in global_rank(df, ["x", "seq"], partitions=9).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [ranked[s] for s in order] == list(range(len(order)))
    first = [r["seq"] for r in ordered_cap(df, 5, ["x", "seq"]).collect()]
    assert sorted(first, key=lambda s: order.index(s)) == order[:5]


def test_ordered_dedup_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, text string").repartition(8)
    got = {r["text"]: r["pos"] for r in ordered_dedup(df, "text", ["pos"]).collect()}
    want = {}
    for p, t in sorted(rows):
        want.setdefault(t, p)
    assert got == want


def test_running_sums_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 4), (4, "a", 8)], "seq long, grp string, x int")
    got = {r["seq"]: r["sx"] for r in running_sums(df, ["grp"], ["seq"], {"sx": F.col("x")}).collect()}
    assert got == {1: 1, 2: 3, 3: 4, 4: 12}


def test_ordered_dedup_plan_has_no_sort_aggregate(spark):
    df = spark.createDataFrame([(2, 0, "b"), (1, 1, "b"), (1, 0, "a"), (1, 2, None), (3, 0, None)], "p long, c int, t string")
    out = ordered_dedup(df, "t", ["p", "c"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, "b"), (1, 0, "a"), (1, 2, None)], key=str)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_global_rank_shuffles_rows_once(spark):
    from pyspark.sql import functions as F
    from sparkrecall.operators.ordering import global_rank
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    out = global_rank(df, ["k"], out="at")
    plan = out._jdf.queryExecution().executedPlan().toString()
    text_shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line]
    assert not text_shuffles and "row_number" not in plan   # numbered while they were written
    rows = sorted(out.collect(), key=lambda r: r.k)
    assert [r["at"] for r in rows] == list(range(1000)) and out.columns == ["k", "text", "at"]
