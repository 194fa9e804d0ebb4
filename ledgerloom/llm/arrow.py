"""Running a function over the Arrow batches of a text column, and hash buckets of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm import words as W


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, in a session whose Arrow batches are at most BATCH_ROWS and BATCH_BYTES where they were larger.

    Spark's defaults suit rows of numbers; with texts a batch is held several times over on both sides of the worker's socket."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_texts(df: DataFrame, text: Column, fields: str, start: Callable[[], Callable[[W.Texts], list]], group_bytes: int = W.GROUP_BYTES, carry: list[str] | None = None) -> DataFrame:
    """(row, new fields): each row as a struct of its own columns (``carry``: of some) beside what a function makes of its text.

    ``start`` runs once a task and returns the function; that gets a group of texts and returns, for each new field, a value for each text
    of the group. The text itself isn't sent back unless it is one of the row's columns."""
    schema = T._parse_datatype_string(fields)
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = ["row", *(f.name for f in schema.fields)]
    row = F.struct("*") if carry is None else F.struct(*(F.col(f"`{c}`") for c in carry))
    source = small_batches(df).select(row.alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            parts = [work(texts) for texts in W.groups(batch.column("text"), group_bytes)]
            columns = [pa.concat_arrays([pa.array(p[i], t) for p in parts]) if parts else pa.array([], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=names)
        pa.default_memory_pool().release_unused()

    out = T.StructType([T.StructField("row", source.schema["row"].dataType), *schema.fields])
    return source.mapInArrow(run, out)
