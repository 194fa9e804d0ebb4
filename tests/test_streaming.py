"""Statement uploads as a stream: the bronze lines equal the batch bronze of the same files."""

from pyspark.sql import functions as F

from ledgerloom.plans import catalogue, fixtures as fx
from ledgerloom.session import scratch_path
from ledgerloom.streaming.uploads import start_statement_stream

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    folder = fx.statement_files(spark, SF_SMALL)
    out = scratch_path(spark, "stream_bronze")
    q = start_statement_stream(spark, folder, out, fx.PAGE_HEADER, max_files_per_trigger=40)
    q.awaitTermination(600)
    got = spark.read.parquet(out).drop("epoch")
    want = catalogue.QUERIES["bronze_roundtrip"](spark, SF_SMALL)
    assert got.count() == want.count() == 2257
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_split_reads_keep_line_order(spark):
    """A file read in many splits (tiny split size, no multiLine) numbers its lines exactly like one task would."""
    from pyspark.sql import functions as F

    from ledgerloom.sources.files import read_files

    folder = fx.statement_files(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")  # every file is cut into several splits
        raw = spark.read.option("header", True).csv(folder)
        assert raw.rdd.getNumPartitions() > 2 * 150
        split = read_files(spark, folder, header=True, multi_line=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = read_files(spark, folder, header=True)
    cols = ["source_file", "line_no", "`Particulars `", "`Debit `"]
    assert split.select(*cols).exceptAll(whole.select(*cols)).count() == 0
    assert split.count() == whole.count() == 2257
    assert split.where(F.col("line_no") == 1).count() == 150
