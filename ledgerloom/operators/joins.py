"""Join helpers that stay exact and skew-safe.

* ``join_per_key``: joins a large table with a table that has at most a few
  rows per key (per-party verdicts, name pairs). The small side is written
  once, its rows and bytes are counted, and it is broadcast only under both bounds;
  above them the join stays a shuffle join and AQE splits hot partitions.
* ``contains_*``: "haystack contains needle" within a key, without a nested-loop join, by an inverted index of grams (runs of ``GRAM`` characters). Each
  haystack text emits each of its grams once, so its rows grow with its length, whatever the needles' lengths. Each needle is filed under the one of its
  own grams that the fewest haystack texts of its key have (none at all: it is contained nowhere). Texts and needles that share that gram are the
  candidates, and are verified. A needle shorter than a gram is a gram of its own length, which texts emit only where their key has such needles.
  Where all needles have one key and are many, the longer ones have longer grams, as the texts that share a short one grow with the texts.
  Grams are compared by a hash of key and gram, which can only add candidates. Exact; equal needles and equal texts of a key are looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .scan import is_plain_scan, quoted

# Characters of a gram of the containment index.
GRAM = 4
# Longer grams, and the needles from which on one is used.
LONG_GRAMS = (8, 16, 32)
MANY_NEEDLES = 1024
# Largest per-key table that is broadcast to every task.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: a word a column, and the content of strings, binaries and nested values."""
    size = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for f in df.schema.fields:
        value = quoted(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            continue
        size = size + F.coalesce(F.octet_length(value), F.lit(0))
    return size


def bounded_small(small: DataFrame, name: str, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Materialise ``small`` (unless it is already a plain file scan) and say whether it may be
    broadcast: its rows and their bytes are counted against the bounds."""
    if not is_plain_scan(small):
        small = materialize(small, name)
    rows, size = small.agg(F.count(F.lit(1)), F.sum(row_bytes(small))).first()
    return small, rows <= max_rows and (size or 0) <= max_bytes


def join_per_key(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    *,
    name: str = "per_key",
    max_rows: int = MAX_BROADCAST_ROWS,
    checked: bool | None = None,
) -> DataFrame:
    """Join ``big`` with a per-key table; broadcast it only under a checked bound of rows and bytes.

    ``on``: column names, or a function (big, small) -> condition (``small``
    is replaced by its written copy). ``checked`` lets a caller that already materialised and counted ``small``
    pass the verdict of ``bounded_small``.
    """
    if checked is None:
        small, checked = bounded_small(small, name, max_rows)
    if callable(on):
        on = on(big, small)
    return big.join(F.broadcast(small) if checked else small, on, how)


def grams(text: Column, size) -> Column:
    """The distinct runs of ``size`` characters of a text (none if it is shorter)."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: text.substr(at, F.lit(size) if isinstance(size, int) else size))
    return F.when(n >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def gram_keys(keys: Sequence[str], runs: Column) -> Column:
    """Hashes of a key with each of its grams."""
    return F.transform(runs, lambda run: F.xxhash64(*[F.col(k) for k in keys], run))


def gram_sizes(needles: DataFrame, keys: Sequence[str], needle: str, one_key: bool = False) -> DataFrame:
    """(keys, _sizes): the lengths of grams that the needles of a key are filed under, a handful at most."""
    size = F.least(F.length(needle), F.lit(GRAM))
    if one_key:
        for n in LONG_GRAMS:
            size = F.when(F.length(needle) >= n, F.lit(n)).otherwise(size)
        counts = needles.groupBy(*keys, size.alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
        needles, size = counts, F.when((F.col("_size") > GRAM) & (F.col("_n") < MANY_NEEDLES), F.lit(GRAM)).otherwise(F.col("_size"))
    return needles.groupBy(*keys).agg(F.collect_set(size).alias("_sizes"))


def text_grams(hay: DataFrame, keys: Sequence[str], text: str, needles: DataFrame, needle: str, one_key: bool = False) -> DataFrame:
    """(keys, _text, _gram): every gram of every distinct text of a key with needles, by its hash, of the lengths that the needles of the key are filed under."""
    texts = hay.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")).distinct()
    sizes = gram_sizes(needles, keys, needle, one_key)
    texts = texts.join(F.broadcast(sizes) if one_key else sizes, list(keys))
    runs = F.flatten(F.transform("_sizes", lambda size: grams(F.col("_text"), size)))
    return texts.select(*keys, "_text", F.explode(gram_keys(keys, runs)).alias("_gram"))


def needle_grams(needles: DataFrame, keys: Sequence[str], needle: str, one_key: bool = False) -> DataFrame:
    """(keys, needle, _gram): the grams under which a needle may be filed."""
    size = F.least(F.length(needle), F.lit(GRAM))
    if one_key:
        needles = needles.join(F.broadcast(gram_sizes(needles, keys, needle, True)), list(keys))
        size = F.array_max(F.filter("_sizes", lambda n: n <= F.length(needle)))
    return needles.select(*keys, needle, F.explode(gram_keys(keys, grams(F.col(needle), size))).alias("_gram"))


def contains_matches(needles: DataFrame, keys: Sequence[str], needle: str, hay: DataFrame, text: str, one_key: bool = False) -> DataFrame:
    """(keys, _needle, _text): the distinct needles and the distinct texts of the same keys that contain them. Null and empty needles match nothing.
    ``one_key``: the keys have one value (so per-key tables are one row)."""
    keys = list(keys)
    wanted = needles.where(F.length(needle) > 0).select(*keys, F.col(needle).alias("_needle")).distinct()
    held = text_grams(hay, keys, text, wanted, "_needle", one_key)
    common = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = needle_grams(wanted, keys, "_needle", one_key).join(common, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    filed = counted.groupBy(*keys, "_needle").agg(F.min("_n").alias("_n"), F.min_by("_gram", "_n").alias("_gram")).where(F.col("_n") > 0).drop("_n")
    return held.join(filed, [*keys, "_gram"]).where(F.contains("_text", "_needle")).select(*keys, "_needle", "_text")


def _rows_without(rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], column: str, found: DataFrame, found_column: str) -> DataFrame:
    """Rows whose value isn't in ``found``; rows without a value stay, spread by ``row_id``, as they would all meet in one task."""
    found = found.select(*keys, F.col(found_column).alias("_value"), F.lit("").alias("_id")).distinct()
    spread = rows.withColumn("_value", F.coalesce(F.col(column), F.lit(""))).withColumn(
        "_id", F.when(F.col(column).isNull(), F.concat_ws("/", F.lit("row"), *[F.col(c).cast("string") for c in row_id])).otherwise(F.lit(""))
    )
    return spread.join(found, [*keys, "_value", "_id"], "left_anti").drop("_value", "_id")


def contains_anti_needles(needles: DataFrame, keys: Sequence[str], row_id: Sequence[str], needle: str, hay: DataFrame, text: str) -> DataFrame:
    """Needle rows for which no haystack row with the same keys contains the needle; rows without a needle are kept."""
    return _rows_without(needles, keys, row_id, needle, contains_matches(needles, keys, needle, hay, text), "_needle")


def contains_anti_haystack(hay: DataFrame, keys: Sequence[str], row_id: Sequence[str], text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Haystack rows that contain none of the needles of the same keys; rows without a text are kept."""
    return _rows_without(hay, keys, row_id, text, contains_matches(needles, keys, needle, hay, text), "_text")
