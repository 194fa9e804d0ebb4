"""Per-party files: statements and ledger sheets exported one file per party.

Readers keep the order of lines inside every file: ``multiLine`` keeps a file
in one split, ``monotonically_increasing_id`` is increasing within a split,
and the numbered lines are written once so that every later use sees the same
numbers. Line numbers are then made dense per file with ``ordered_scan``.

A file's label is its name (``SAP_<party>.csv``). Files written by Spark live
in ``source_file=<name>`` folders, whose value partition discovery decodes;
plain folders of files use the (URL-decoded) file name. Very many small files
are kept in bundles: CSV of whole files one after the other, each line with its
file's name before its cells, so no folder is listed or made per file.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem, url_decoded
from ..operators.joins import bounded_small, join_per_key
from ..operators.scan import BUCKET_ROWS, is_plain_scan, ordered_scan, quoted
from ..session import materialize

FILE_COL = "source_file"


def write_files(df: DataFrame, path: str, order: Sequence[str], *, header: bool = False) -> None:
    """One CSV per value of ``source_file``, lines in ``order``; text is written as is (no trimming)."""
    (
        df.repartition(FILE_COL)
        .sortWithinPartitions(FILE_COL, *order)
        .drop(*order)
        .write.mode("overwrite")
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .partitionBy(FILE_COL)
        .csv(path)
    )


def write_bundles(df: DataFrame, path: str, order: Sequence[str], *, header: bool = False) -> None:
    """The lines of all files as bundles, a file's lines together in one of them in ``order``; ``header`` gives every bundle a line of column names."""
    (
        df.select(FILE_COL, *[quoted(c) for c in df.columns if c != FILE_COL])
        .repartition(FILE_COL)
        .sortWithinPartitions(FILE_COL, *order)
        .drop(*order)
        .write.mode("overwrite")
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


META = ["_file_path", "_file_name", "_blk"]


def with_file_metadata(raw: DataFrame) -> DataFrame:
    """Keep the scan's file metadata as plain columns (a streaming micro-batch no longer has ``_metadata``)."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.file_name").alias("_file_name"),
        F.col("_metadata.file_block_start").alias("_blk"),
    )


def file_label(raw: DataFrame) -> Column:
    """The file a line came from: the ``source_file=<name>`` folder value, else the file's own name."""
    if FILE_COL in raw.columns:
        return F.col(FILE_COL).cast("string")
    # the path is a URI (escaped once) and a partition folder value is escaped by the writer as well
    folder = F.regexp_extract(F.col("_file_path"), f"/{FILE_COL}=([^/]*)/", 1)
    return F.when(folder != "", url_decoded(url_decoded(folder))).otherwise(url_decoded(F.col("_file_name")))


def number_lines(raw: DataFrame) -> DataFrame:
    """source_file + dense 1-based ``line_no`` per file, in file order, for freshly scanned CSV lines.

    Within a split ``monotonically_increasing_id`` follows the file; splits of one file are ordered by their
    start offset. The numbered rows are written once, so both uses inside the ordered scan see the same ids."""
    if "_blk" not in raw.columns:
        raw = with_file_metadata(raw)
    cols = [c for c in raw.columns if c != FILE_COL and c not in META]
    numbered = raw.select(
        file_label(raw).alias(FILE_COL), "_blk", F.monotonically_increasing_id().alias("_pos"), *[F.col(f"`{c}`") for c in cols],
    )
    numbered = materialize(numbered, "file_lines")
    # a split and a stretch of positions in it are a bucket that keeps the order: no range sort, no second write
    bucket = F.struct("_blk", F.floor(F.col("_pos") / F.lit(BUCKET_ROWS)))
    return ordered_scan(numbered, [FILE_COL], ["_blk", "_pos"], row_number="line_no", bucket=bucket, cheap=True).drop("_blk", "_pos")


def widest_line(spark: SparkSession, path: str) -> int:
    """Columns of the widest line of the files, at most (commas inside quotes count too): one pass over the text."""
    most = spark.read.text(path).agg(F.max(F.regexp_count("value", F.lit(","))).alias("n")).head()["n"]
    return int(most or 0) + 1


def text_schema(columns: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(columns)])


def read_files(
    spark: SparkSession, path: str, *, header: bool = False, schema: T.StructType | None = None, multi_line: bool = True, bundled: bool = False
) -> DataFrame:
    """All files below ``path`` with ``source_file`` and a dense ``line_no`` per file (1-based, data lines).

    ``header=True`` takes the first file's header for all; files that may differ are read without it and then go through ``by_header``. Without
    a header and a schema, the columns ``_c0``, ``_c1``, ... are as many as the widest line has.

    ``multi_line`` allows quoted line breaks inside a cell but keeps every file in one task; with ``False`` a
    large file is split over many tasks and its line order still comes out exact (split start, position).

    ``bundled``: the files are in bundles (``write_bundles``); ``schema`` is that of their cells."""
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    if schema is None and not header:
        schema = text_schema(widest_line(spark, path) - int(bundled))
    if bundled and schema is not None:
        schema = T.StructType([T.StructField(FILE_COL, T.StringType()), *schema])
    if schema is not None:
        reader = reader.schema(schema)
    return number_lines(reader.csv(path))


def missing_columns(headers: DataFrame, required: Sequence[str]) -> DataFrame:
    """S4 per file: (source_file, missing) for files whose header lacks a required column."""
    req = F.array(*[F.lit(c) for c in required])
    return headers.select(
        FILE_COL, F.filter(req, lambda c: ~F.coalesce(F.array_contains(F.col("header"), c), F.lit(False))).alias("missing")
    ).where(F.size("missing") > 0)


def by_header(lines: DataFrame, names: Mapping[str, str], header_line: int = 1, what: str = "file") -> DataFrame:
    """source_file, line_no (1-based, after the header) and the columns ``names`` (header name -> column), found in every file's own header line.

    Files may order their columns differently and have others between; header names are trimmed, and of two equal ones the first counts. The headers are a
    table of one row per file that is joined to the lines: no collect, no loop over files. A file without a required column is an error."""
    if not is_plain_scan(lines):
        lines = materialize(lines, "numbered_lines")  # read for the headers and for the data: numbered once, not for each
    values = F.array(*[F.col(c) for c in lines.columns if re.fullmatch(r"_c\d+", c)])
    headers = lines.where(F.col("line_no") == header_line).select(FILE_COL, F.transform(values, lambda x: F.trim(x)).alias("header"))
    headers, small = bounded_small(headers, "file_headers")
    bad = missing_columns(headers, list(names)).take(1)
    if bad:
        raise ValueError(f"{what} {bad[0][FILE_COL]}: missing column(s) {bad[0]['missing']}")
    data = lines.where(F.col("line_no") > header_line).select(FILE_COL, (F.col("line_no") - header_line).alias("line_no"), values.alias("_v"))
    data = join_per_key(data, headers, FILE_COL, checked=small)
    pick = [F.try_element_at(F.col("_v"), F.array_position(F.col("header"), name).cast("int")).alias(c) for name, c in names.items()]
    return data.select(FILE_COL, "line_no", *pick)


def party_from_file(df: DataFrame, prefixes: Sequence[str] = (), out: str = "customer_name") -> DataFrame:
    """Party name = file name without folder and extension, without the caller's upload prefix."""
    stem = file_stem(F.col(FILE_COL))
    for p in prefixes:
        stem = F.when(stem.startswith(p), stem.substr(len(p) + 1, 1 << 20)).otherwise(stem)
    return df.withColumn(out, stem)
