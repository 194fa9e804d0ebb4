"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

* Size of a document: its runs of ``[^\\x20\\x09-\\x0D]`` (null text: 0).
* Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words by weight. A target stops at
  ``MAX_EPOCHS`` times its source's size; the excess is shared again by weight among the others. That ends at one
  level of words per weight, found by prefix sums over the sources sorted by size per weight.
* Each source's documents stand in an order given by a hash of doc_id (of the text where there is none). The source is passed over as often as its
  target holds it whole; the rest of the target is taken from the front of that order.
* Curriculum: over training time t in [0, 1] a source's weight is target * (1 - a + 2at), where a is the slope of its weight.
  The demand for its words up to t is the integral, target * ((1 - a)t + at²). A copy of a document starts training where that
  demand reaches the middle of the copy's place in the source's stream; copies are range-sorted by that position.

A source may hold any share of the rows: its prefix sums run over hash buckets of about ``BUCKET_DOCS`` documents, then over bucket
totals.

Defined results: null and empty texts have size 0 and take 0 words (whole-document mixes repeat them like others); a source without words
has target 0; ties in the order (repeated ids) are broken by size and a hash of the text; repeated rows are
rows of their own (rows equal in source, id and, without id, in text share a bucket); an empty table gives an empty mix. Other columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize

MAX_EPOCHS = 3
BUCKET_DOCS = 4096
WEIGHTS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Slope of the schedule by weight: light sources come late, heavy ones early.
SLOPES = {1: 0.5, 2: 0.0, 3: -0.5}


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, docs, source_size, weight, target) from rows with source and size; one row a source."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", (rank - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    return per.select("source", "docs", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def _text_key(id_column: str) -> Column:
    """Rows without id are told apart by their text, so that they don't meet in one bucket."""
    return F.when(F.col(id_column).isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("text_key")


def plan(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Rows (row struct, id, text_key, source, size, tie) with source_size, weight, target, before, passes, extra and taken.

    ``before`` is the words of the source ahead of the document, ``passes`` its whole copies and ``extra`` the words of a last copy: the rest
    of the target up to the last word, or with ``whole`` all words if the middle of the copy is within the rest."""
    targets = source_targets(rows)
    key = F.coalesce(F.md5(F.col("id").cast("string")), F.col("text_key"))
    keyed = rows.withColumn("key", key).withColumn("place", F.conv(F.substring("key", 1, 6), 16, 10).cast("bigint"))
    same = keyed["source"].eqNullSafe(targets["source"])
    keyed = keyed.join(targets, same, "left").drop(targets["source"])
    keyed = keyed.withColumn("bucket", F.shiftright(F.col("place") * F.ceil(F.col("docs") / F.lit(BUCKET_DOCS)), 24))
    # totals of the buckets come from the rows' own slim columns
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(totals, out["source"].eqNullSafe(totals["s"]) & (out["bucket"] == totals["b"]), "left").withColumn("before", F.col("bucket_before") + F.col("inside"))
    words = F.floor("target")
    out = out.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("bigint"))
    left = words - F.col("passes") * F.col("source_size")
    if whole:
        extra = F.when(2 * F.col("before") + F.col("size") < 2 * left, F.col("size")).otherwise(F.lit(0))
    else:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    out = out.withColumn("extra", extra.cast("bigint")).withColumn("copies", F.col("passes") + ((2 * F.col("before") + F.col("size") < 2 * left) if whole else (F.col("extra") > 0)).cast("bigint"))
    return out.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")).drop("key", "text_key", "place", "bucket", "s", "b", "bucket_before", "inside", "docs")


def position(copy: Column) -> Column:
    """When training reaches the middle of a copy, from 0 to 1: the inverse of the cumulative demand."""
    middle = copy * F.col("source_size") + F.col("before") + F.when(copy < F.col("passes"), F.col("size")).otherwise(F.col("extra")) / 2
    q = F.least(F.lit(1.0), middle / F.floor("target"))
    slope = F.lit(0.0)
    for weight, a in SLOPES.items():
        slope = F.when(F.col("weight") == weight, F.lit(a)).otherwise(slope)
    solved = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q)) / (2 * slope)
    return F.when(F.floor("target") > 0, F.when(slope == 0, q).otherwise(solved)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents' columns, each document as often as the mix takes it (whole copies), range-sorted by training position."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), _text_key(id_column), F.col("source"), words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    copies = plan(rows, whole=True).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return copies.select("row", position(F.col("copy")).alias("position")).repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_position (null where nothing is taken) of each document, range-sorted by position."""
    slim = docs.select(F.struct(F.col("doc_id")).alias("row"), F.col("doc_id").alias("id"), _text_key("doc_id"), F.col("source"), words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    out = plan(materialize(slim, "sizes"))
    first = F.when(F.col("taken") > 0, position(F.lit(0)))
    out = out.select("row.doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("first_position"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM per WINDOW b AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM lev),
c AS (SELECT d.*, source_size, weight, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(floor(target) AS BIGINT) AS whole, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // CAST(source_size AS BIGINT) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, whole - passes * source_size - before)) AS extra FROM c),
y AS (SELECT *, passes * size + extra AS taken, CASE weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS a,
    CAST(before AS DOUBLE) + CASE WHEN passes > 0 THEN size ELSE extra END / 2::DOUBLE AS middle FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN a = 0 THEN least(1, middle / whole) ELSE (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * least(1, middle / whole))) / (2 * a) END, 9) END AS first_position
FROM y
"""
