"""Gold runs: staged rows are unseen until published, a run published again is replaced, also by nothing; other runs stay."""

import datetime as dt
from decimal import Decimal as D

from ledgerloom.schemas import GOLD
from ledgerloom.session import scratch_path
from ledgerloom.sources import sinks


def gold(spark, *names):
    return spark.createDataFrame([(n, dt.date(2024, 4, 1), None, D("1.5"), "flag") for n in names], GOLD)


def names(spark, path, run=None):
    return sorted((r["run_id"], r["customer_name"]) for r in sinks.read_gold(spark, path, run).collect())


def test_runs(spark):
    path = scratch_path(spark, "gold_runs")
    sinks.append_gold(gold(spark), path, "r0")
    assert names(spark, path) == []
    sinks.append_gold(gold(spark, "a"), path, "r1")
    sinks.append_gold(gold(spark, "b", "c"), path, "r2")
    assert names(spark, path) == [("r1", "a"), ("r2", "b"), ("r2", "c")]
    sinks.append_gold(gold(spark), path, "r1")  # tried again, now without rows
    assert names(spark, path) == [("r2", "b"), ("r2", "c")] and names(spark, path, "r1") == []
    attempt = sinks.stage_gold(gold(spark, "d"), path, "r2")  # the job dies here
    assert names(spark, path, "r2") == [("r2", "b"), ("r2", "c")]
    sinks.publish_gold(spark, path, "r2", attempt)  # or goes on
    assert names(spark, path, "r2") == [("r2", "d")]
    runs = {r["run_id"]: r["n_rows"] for r in sinks.published_runs(spark, path).collect()}
    assert runs == {"r0": 0, "r1": 0, "r2": 1}


def test_two_writers_of_one_run(spark):
    """Both stage before either publishes: the later publication counts, rows are never mixed."""
    path = scratch_path(spark, "gold_runs")
    one, two = sinks.stage_gold(gold(spark, "a", "b"), path, "r1"), sinks.stage_gold(gold(spark, "c"), path, "r1")
    sinks.publish_gold(spark, path, "r1", two)
    assert names(spark, path) == [("r1", "c")]
    sinks.publish_gold(spark, path, "r1", one)
    assert names(spark, path) == [("r1", "a"), ("r1", "b")]


def test_one_run_reads_its_own_folders(spark):
    path = scratch_path(spark, "gold_runs")
    for run in ("r1", "r2"):
        sinks.append_gold(gold(spark, run), path, run)
    plan = sinks.read_gold(spark, path, "r2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1][:200]
