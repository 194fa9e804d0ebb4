"""ordered_scan equals the plain window for every bucketing (integer buckets, range buckets, tiny buckets)."""

from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.scan import int_bucket, ordered_scan


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for k, n in (("hot", 3000), ("a", 7), ("b", 1), (None, 5)):
        for i in range(n):
            v = None if i % 7 == 3 else Decimal(i % 11) - Decimal("4.25")
            d = None if i % 3 else i
            rows.append((k, i * 3 + 1, v, d))
    return spark.createDataFrame(rows, "k string, pos long, v decimal(22,5), d long")


def expected(df):
    w = Window.partitionBy("k").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "k", "pos", F.row_number().over(w).cast("long").alias("rn"),
        F.sum("v").over(run).cast("decimal(22,5)").alias("s"), F.last("d", True).over(run).alias("f"),
    )


@pytest.mark.parametrize("bucket", ["int", "tiny", "range"])
def test_ordered_scan_equals_window(spark, lines, bucket):
    b = {"int": int_bucket("pos"), "tiny": int_bucket("pos", 16), "range": None}[bucket]
    got = ordered_scan(lines, ["k"], ["pos"], row_number="rn", sums={"s": F.col("v")}, fills={"f": F.col("d")},
                       bucket=b, num_ranges=5)
    got = got.select("k", "pos", "rn", F.col("s").cast("decimal(22,5)").alias("s"), "f")
    assert sorted(got.collect(), key=str) == sorted(expected(lines).collect(), key=str)
