"""Readers for the artifacts of a run (all lazy DataFrame reads, explicit schemas).

Positions: file order is semantic for QA datasets (first-n selection, fallback
ids), so readers attach an explicit ``pos`` column instead of relying on
partition order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.memory import MEMORY_DDL
from ..operators.ordering import ordered_cap

LOG_V2_COLUMNS = ["timestamp", "query", "confidence", "memory_id", "sim_query", "sim_answer", "sim_docs",
                  "source", "latency", "memory_size", "retrieval_count", "memory_count"]
LOG_V1_COLUMNS = [c for c in LOG_V2_COLUMNS if c not in ("memory_id", "memory_count")]

SUMMARY_DDL = (
    "run_id string, timestamp string, dataset string, split string, num_questions long, smoke_size long, "
    "total_queries long, phase string, corpus_size long, documents_before_chunking long, mode string, "
    "memory_mode string, model string, embedding_model string, threshold double, avg_em double, avg_f1 double, "
    "avg_rouge_l double, avg_bleu double, avg_confidence double, avg_latency_s double, memory_path_count long, "
    "retrieval_path_count long, memory_path_rate double, retrieval_path_rate double, retrieval_call_rate double, "
    "hallucination_rate double, memory_path struct<count:long, avg_em:double, avg_f1:double, avg_confidence:double>, "
    "retrieval_path struct<count:long, avg_em:double, avg_f1:double, avg_confidence:double>, "
    "final_memory_size long, memory_file string, index_file string, log_file string, _corrupt_record string")


def with_file_positions(df: DataFrame, pos: str = "pos") -> DataFrame:
    """0-based position in file order (files by path, rows in file order), all
    JVM-side. ``df`` must be a file scan. Parquet exposes the row index within
    a file; for text formats a split is read in order inside one task, so the
    key (file, split start, monotonically increasing id) orders rows exactly.
    Dense positions come from the distributed ``global_rank`` (whose
    checkpoint also freezes the id)."""
    from ..operators.ordering import global_rank
    cols = df.columns
    try:
        keyed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.lit(0).cast("long").alias("_b"),
                          F.col("_metadata.row_index").alias("_i"))
        keyed.schema  # noqa: B018 -- forces analysis: row_index exists for Parquet only
    except Exception:  # noqa: BLE001
        keyed = df.select("*", F.col("_metadata.file_path").alias("_f"),
                          F.col("_metadata.file_block_start").alias("_b"),
                          F.monotonically_increasing_id().alias("_i"))
    return global_rank(keyed, ["_f", "_b", "_i"], out=pos).select(*[F.col(f"`{c}`") for c in cols], pos)


def read_samples(spark: SparkSession, path: str, n: int | None = None, fmt: str = "json",
                 schema: T.StructType | str | None = None, pos: str = "pos") -> DataFrame:
    """A QA split in stored order with a ``pos`` column; ``n`` keeps the first n
    (an ordered limit, never a bare one)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if pos not in df.columns:
        df = with_file_positions(df, pos)
    return ordered_cap(df, n, [pos])


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Memory store: a JSON array file (or parquet folder of entries); a missing
    path gives an empty table with the memory schema."""
    try:
        if path.endswith(".json"):
            return spark.read.schema(MEMORY_DDL).option("multiLine", True).json(path)
        return spark.read.schema(MEMORY_DDL).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], MEMORY_DDL)
        raise


def read_log(spark: SparkSession, path: str, seq: str | None = None) -> DataFrame:
    """Telemetry CSV (header, quoted multi-line fields) -> typed log; both the
    older 10-column and the 12-column layouts (missing columns -> null).
    ``seq``: also number rows in file order."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("inferSchema", False).csv(path))
    if seq is not None:
        raw = with_file_positions(raw, seq)
    for c in LOG_V2_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    dbl = lambda c: F.col(c).try_cast("double")
    return raw.select(
        F.col("timestamp").try_cast("timestamp").alias("timestamp"), "query", dbl("confidence").alias("confidence"),
        F.col("memory_id").try_cast("long").alias("memory_id"), dbl("sim_query").alias("sim_query"),
        dbl("sim_answer").alias("sim_answer"), dbl("sim_docs").alias("sim_docs"), "source",
        dbl("latency").alias("latency"), F.col("memory_size").try_cast("long").alias("memory_size"),
        F.col("retrieval_count").try_cast("long").alias("retrieval_count"),
        F.col("memory_count").try_cast("long").alias("memory_count"),
        *([F.col(seq)] if seq is not None else []),
        *([] if seq is not None else [F.col("_metadata.file_path").alias("file_path")]))


def read_log_with_order(spark: SparkSession, path: str) -> DataFrame:
    """``read_log`` plus ``seq`` = row position in file order (latest = last)."""
    return read_log(spark, path, seq="seq")


def files_named(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """(path, run_name) of the files called ``name`` below ``base_dir``, as plain
    files or as the part files of a Spark folder of that name; ``run_name`` is the
    folder they are in. Only file metadata is read."""
    pattern = "/" + name.replace(".", r"\.") + r"(/part-[^/]*)?$"
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base_dir).select("path")
             .where(F.col("path").rlike(pattern)))
    return found.withColumn("run_name", F.regexp_extract("path", "([^/]*)" + pattern, 1))


def read_summaries(spark: SparkSession, base_dir: str) -> DataFrame:
    """Every ``summary_metrics.json`` below ``base_dir`` (recursive, sorted by
    path); unparseable files are skipped; missing keys are null."""
    text = (spark.read.text(base_dir, wholetext=True, recursiveFileLookup=True)
            .withColumn("path", F.col("_metadata.file_path")).where(F.col("path").rlike(r"/summary_metrics\.json(/part-[^/]*)?$")))
    one = text.withColumn("s", F.from_json("value", SUMMARY_DDL))
    fields = [f.split(" ")[0] for f in T._parse_datatype_string(SUMMARY_DDL).fieldNames() if f != "_corrupt_record"]
    return (one.where("trim(value) != '' and s is not null and s._corrupt_record is null")
            .select(*[F.col(f"s.{f}") for f in fields], "path").orderBy("path"))


#: Prediction columns that are numbers or flags; all others are strings.
PREDICTION_TYPES = {"confidence": "double", "em": "double", "f1": "double", "rouge_l": "double", "bleu": "double", "latency_s": "double",
                    "answer_contains_gold": "boolean", "memory_size": "long", "retrieval_count": "long", "memory_count": "long"}


def _csv_by_header(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """CSV files (path, ...) of one or more layouts as one table with ``_path``: a
    multi-path read per distinct header, united by name."""
    paths = [r["path"] for r in files.select("path").collect()]  # file names of runs, no rows
    if not paths:
        return None
    first = (spark.read.text(paths, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("value", "\r?\n"), 1).alias("header")))
    layouts: dict[str, list[str]] = {}
    for r in first.where("trim(header) != ''").collect():
        layouts.setdefault(r["header"], []).append(r["path"])
    out = None
    for header, own in sorted(layouts.items()):
        df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(sorted(own))
              .withColumn("_path", F.col("_metadata.file_path")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_predictions_csv(spark: SparkSession, base_dir: str, name: str = "predictions.csv") -> DataFrame:
    """All predictions CSVs below ``base_dir``, each row tagged with the name of
    the folder that holds its file as ``run_name`` (answers may span lines);
    metrics and counters are typed, columns missing in a layout are null."""
    files = files_named(spark, base_dir, name)
    df = _csv_by_header(spark, files)
    if df is None:
        return spark.createDataFrame([], "query_id string, run_name string")
    typed = [F.col(c).try_cast(PREDICTION_TYPES[c]).alias(c) if c in PREDICTION_TYPES else F.col(c) for c in df.columns if c != "_path"]
    pattern = "([^/]*)/" + name.replace(".", r"\.") + r"(/part-[^/]*)?$"
    return df.select(*typed, F.regexp_extract("_path", pattern, 1).alias("run_name"))


def read_predictions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_flat_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Flat one-row summary CSVs (files or Spark folders), in one read per distinct
    layout; differing columns are united by name."""
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return _csv_by_header(spark, files).drop("_path")


def result_inventory(spark: SparkSession, base_dir: str, exts: tuple[str, ...] = ("csv", "json", "txt")) -> DataFrame:
    """(extension, files, size_kb) of result files below ``base_dir`` -- file
    metadata only (the binaryFile content column is never read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base_dir)
             .select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (files.withColumn("extension", ext).filter(F.col("extension").isin(*exts))
            .groupBy("extension").agg(F.count(F.lit(1)).alias("files"),
                                      F.round(F.sum("length") / 1024.0, 1).alias("size_kb")))


def synthetic_qa(spark: SparkSession, rows: list[tuple[str, str]], n: int | None = None) -> DataFrame:
    """A small inline QA table from (question, answer) pairs supplied by the
    caller, in order: pos, query_id ``synthetic_%03d`` of the position,
    question, answer; ``n`` keeps the first n."""
    from ..operators.samples import SYNTHETIC_ID_FORMAT, positional_id
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "pos long, question string, answer string")
    df = df.withColumn("query_id", positional_id("pos", SYNTHETIC_ID_FORMAT))
    return ordered_cap(df, n, ["pos"]).select("pos", "query_id", "question", "answer")
