"""Sinks: bronze lines, the gold table (append per run) and the report export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GOLD, GOLD_COLUMNS


def write_bronze(bronze: DataFrame, path: str) -> None:
    """Bronze lines as Parquet, sorted by statement and line inside every file (row-group
    statistics then prune on statement_id); no shuffle, no folder per statement."""
    bronze.sortWithinPartitions("statement_id", "line_no").write.mode("overwrite").parquet(path)


# Folders of the gold table: the rows of every attempt of a run, and one small record per published attempt.
DATA, RUNS = "data", "runs"
RUN_RECORD = "run_id string, attempt string, published timestamp, n_rows bigint"


def stage_gold(gold: DataFrame, path: str, run_id: str) -> str:
    """Writes a run's rows where no reader sees them yet; returns the attempt's name for ``publish_gold``."""
    attempt = uuid.uuid4().hex
    rows = gold.select(*GOLD_COLUMNS).withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
    rows.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/{DATA}")
    return attempt


def publish_gold(spark: SparkSession, path: str, run_id: str, attempt: str) -> None:
    """Makes a staged attempt the run's content: one record, in one file, which is there or not."""
    n = _attempts(spark, path).where((F.col("run_id") == run_id) & (F.col("attempt") == attempt)).count()
    record = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published"), F.lit(n).cast("long").alias("n_rows"))
    record.coalesce(1).write.mode("append").json(f"{path}/{RUNS}")


def append_gold(gold: DataFrame, path: str, run_id: str) -> None:
    """Append one run's gold rows; the table is created by the first append.

    A run is staged, then published. Until then, or if the job dies between, readers see what they saw before; the staged rows stay unseen. A run that is
    published again is replaced by its last publication, also by one without rows; other runs are not touched. Of two writers of
    one run at once both publish, and the later publication counts (of the same moment, the larger attempt name)."""
    publish_gold(gold.sparkSession, path, run_id, stage_gold(gold, path, run_id))


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    fields = [*GOLD.fields, T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{DATA}")


def published_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt, published, n_rows) of the attempt that counts of each run."""
    last = F.max_by(F.struct("attempt", "published", "n_rows"), F.struct("published", "attempt")).alias("r")
    return spark.read.schema(RUN_RECORD).json(f"{path}/{RUNS}").groupBy("run_id").agg(last).select("run_id", "r.*")


def read_gold(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The published rows of the gold table with their ``run_id``, or of one run (only that run's folders are read)."""
    rows, runs = _attempts(spark, path), published_runs(spark, path).select("run_id", "attempt")
    if run_id is not None:
        rows, runs = rows.where(F.col("run_id") == F.lit(run_id)), runs.where(F.col("run_id") == F.lit(run_id))
    return rows.join(runs, ["run_id", "attempt"], "left_semi").select(*GOLD_COLUMNS, "run_id")


def empty_gold(spark: SparkSession) -> DataFrame:
    """The typed empty gold relation (every party balanced)."""
    return spark.createDataFrame([], GOLD)


def export_report(gold: DataFrame, path: str) -> None:
    """The reconciliation report as CSV with a header row (opens in any spreadsheet)."""
    gold.select(*GOLD_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("header", True).csv(path)
