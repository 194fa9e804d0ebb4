"""Statements that arrive as uploads: a file-source stream that turns every new statement file into bronze lines.

The reference processes one uploaded statement at a time. Here a folder of
arriving statement CSVs is a Structured Streaming file source; each
micro-batch numbers the lines of its files, applies the bronze rules (R1) and
overwrites its own ``epoch=<id>`` folder, so a retried batch replaces its
output instead of duplicating it. The stream's progress lives in the
checkpoint folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.bronze import to_bronze
from ..schemas import BRONZE_COLUMNS, BRONZE_HEADER
from ..session import scratch_path
from ..sources.files import FILE_COL, by_header, number_lines, party_from_file, text_schema, with_file_metadata

# Columns that are read of a statement file at least; a stream's schema is fixed before its files are known.
COLUMNS = 32


def bronze_batch(batch: DataFrame, out: str, epoch: int, prefixes: Sequence[str]) -> None:
    raw = number_lines(batch.drop(FILE_COL) if FILE_COL in batch.columns else batch)
    raw = by_header(raw, dict(zip(BRONZE_HEADER, BRONZE_COLUMNS)), what="statement")
    lines = party_from_file(raw, prefixes, out="statement_id")
    to_bronze(lines.select("statement_id", "line_no", *BRONZE_COLUMNS)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def start_statement_stream(
    spark: SparkSession,
    folder: str,
    out: str,
    header: Sequence[str],
    *,
    prefixes: Sequence[str] = ("temp_",),
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops (for batch-like runs and tests).

    ``header``: the names as printed on a usual file, which gives the number of columns to read; each file's columns are found in its own header."""
    stream = (
        spark.readStream.schema(text_schema(max(len(header), COLUMNS)))
        .option("multiLine", True).option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    stream = with_file_metadata(stream)
    writer = stream.writeStream.foreachBatch(lambda df, epoch: bronze_batch(df, out, epoch, prefixes)).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "statement_stream")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
