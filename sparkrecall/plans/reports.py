"""Cross-run roll-up: discover run summaries, one row per run, best run,
report lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.telemetry import best_run
from ..sources import writers as W
from ..sources.readers import read_predictions_csv, read_summaries


@dataclass
class Aggregate:
    runs: DataFrame
    best: DataFrame
    report: DataFrame


def aggregate_runs(spark: SparkSession, base_dir: str) -> Aggregate:
    s = read_summaries(spark, base_dir)
    best = best_run(s, "avg_f1", order_col="path")
    return Aggregate(W.cross_run_table(s), best, W.master_report(s, best))


def write_roll_up(spark: SparkSession, base_dir: str) -> Aggregate:
    """Aggregates the runs below ``base_dir`` and writes the cross-run table (CSV and
    JSON), the combined predictions and the master report to ``base_dir/roll_up``."""
    s, out = read_summaries(spark, base_dir), base_dir.rstrip("/") + "/roll_up"
    agg = aggregate_runs(spark, base_dir)
    W.write_cross_run(s, f"{out}/all_runs.csv", f"{out}/all_runs.json")
    W.write_combined_predictions(read_predictions_csv(spark, base_dir), f"{out}/combined.csv")
    agg.report.write.mode("overwrite").json(f"{out}/report.json")
    return agg
