"""Running aggregates in file order that do not put a whole party into one task.

A window ``partitionBy(party).orderBy(line)`` sends every row of a party to one
task; when one party holds a third of all rows that task holds a third of the
data. ``ordered_scan`` computes the same running count / sum / forward fill as
a two-level prefix scan instead:

1. every row gets a bucket ``_b`` that is monotone in the order within its key
   (a given integer expression such as ``line_no div 65536``, or the range
   partition of ``repartitionByRange(keys, order)``, written once so that the
   sampled bounds are fixed), so a hot key spans many buckets;
2. a window partitioned by ``(key, _b)`` computes the bucket-local running
   values;
3. a grouped aggregate gives per-bucket totals (small: one row per bucket),
   and a window over those totals gives every bucket its offset;
4. an equi join on ``(key, _b)`` adds the offset to the local value.

All values are exact (decimal sums, counts); the result equals the plain
window for every partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Rows per bucket when the order key is a unique integer (line numbers, sequence numbers).
BUCKET_ROWS = 1 << 16


def int_bucket(order_col: str, rows: int | None = None) -> Column:
    """Bucket of a unique integer order key: at most ``rows`` (default ``BUCKET_ROWS``) rows per bucket and key."""
    return F.floor(F.col(order_col) / F.lit(rows or BUCKET_ROWS)).cast("long")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    row_number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
    bucket: Column | None = None,
    num_ranges: int | None = None,
    cheap: bool | None = None,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (which must be unique within a key).

    row_number: name of a 1-based position column.
    sums: output name -> value; running sum from the first row up to this row.
    fills: output name -> value; last non-null value up to this row (forward fill).
    bucket: order-monotone bucket expression; ``None`` uses range partitions.
    cheap: the input may be evaluated twice (a written table, or a small join with one); ``None``: it may if it is a plain scan.
    """
    sums = dict(sums or {})
    fills = dict(fills or {})
    keys = list(keys)
    order = list(order)
    spark = df.sparkSession
    cols = df.columns

    vals = {f"_s{i}": v for i, v in enumerate(sums.values())}
    fvals = {f"_f{i}": v for i, v in enumerate(fills.values())}
    staged = df.withColumns({**vals, **fvals}) if (vals or fvals) else df
    if bucket is None:
        # Range bounds come from sampling, and a second evaluation may sample
        # differently: the bucketed rows are written once so that both uses
        # below (local window, bucket totals) see the same buckets.
        n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        staged = materialize(
            staged.repartitionByRange(n, *keys, *order).withColumn("_b", F.spark_partition_id().cast("long")),
            "ordered_scan",
        )
    else:
        staged = staged.withColumn("_b", bucket)
        if not (is_plain_scan(staged) if cheap is None else cheap):
            # the rows are read twice below (local window, bucket totals): compute the upstream once
            staged = materialize(staged, "ordered_scan")

    # keys as non-null columns (value or a default, plus an is-null flag): the window, the totals and the offset
    # join then share one hash partitioning, so the big side is shuffled once even when the offsets are not broadcast
    pkeys = []
    for n, k in enumerate(keys):
        dt = staged.schema[k].dataType
        default = F.lit("") if isinstance(dt, T.StringType) else F.lit(0).cast(dt)
        staged = staged.withColumns({f"_kc{n}": F.coalesce(quoted(k), default), f"_kn{n}": quoted(k).isNull()})
        pkeys += [f"_kc{n}", f"_kn{n}"]

    w_local = Window.partitionBy(*pkeys, "_b").orderBy(*order)
    w_run = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_exprs = []
    if row_number:
        local_exprs.append(F.row_number().over(w_local).cast("long").alias("_ln"))
    local_exprs += [F.sum(c).over(w_run).alias(f"_l{c}") for c in vals]
    local_exprs += [F.last(c, ignorenulls=True).over(w_run).alias(f"_l{c}") for c in fvals]
    # the keys travel once, in their non-null form, and get their own back at the end
    own = {k: F.when(~F.col(f"_kn{n}"), F.col(f"_kc{n}")).alias(k) for n, k in enumerate(keys)}
    local = staged.select(*[quoted(c) for c in cols if c not in own], *pkeys, "_b", *local_exprs)

    order_struct = F.struct(*[F.col(c) for c in order])
    tot_exprs = []
    if row_number:
        tot_exprs.append(F.count(F.lit(1)).alias("_tn"))
    tot_exprs += [F.sum(c).alias(f"_t{c}") for c in vals]
    tot_exprs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order_struct)).alias(f"_t{c}") for c in fvals]
    totals = staged.groupBy(*pkeys, "_b").agg(*tot_exprs)

    w_prev = Window.partitionBy(*pkeys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off_exprs = []
    if row_number:
        off_exprs.append(F.coalesce(F.sum("_tn").over(w_prev), F.lit(0)).alias("_on"))
    off_exprs += [F.sum(f"_t{c}").over(w_prev).alias(f"_o{c}") for c in vals]
    off_exprs += [F.last(f"_t{c}", ignorenulls=True).over(w_prev).alias(f"_o{c}") for c in fvals]
    offsets = totals.select(*pkeys, "_b", *off_exprs)

    joined = local.join(offsets, [*pkeys, "_b"], "inner")

    out = [own.get(c, quoted(c)) for c in cols]
    if row_number:
        out.append((F.col("_on") + F.col("_ln")).cast("long").alias(row_number))
    for (name, value), c in zip(sums.items(), vals):
        local_sum, offset = F.col(f"_l{c}"), F.col(f"_o{c}")
        # null only while every value so far is null, as in the plain window
        total = F.coalesce(offset + local_sum, offset, local_sum)
        out.append(total.cast(value_type(staged, c)).alias(name))
    for (name, _), c in zip(fills.items(), fvals):
        out.append(F.coalesce(F.col(f"_l{c}"), F.col(f"_o{c}")).alias(name))
    return joined.select(*out)


def part_offsets(parts: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """The level above ``ordered_scan``: parts of a key (files, statements) with their totals, one row a part. Adds, for each output name, the sum of a
    total over the key's parts before (0 for the first), and ``_part``, the part's number."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {out: F.coalesce(F.sum(c).over(before), F.lit(0)).cast(parts.schema[c].dataType) for out, c in sums.items()}
    return parts.withColumns({"_part": F.row_number().over(w), **sums})


# Logical operators that are cheap to evaluate twice: a file scan with projections and filters.
_CHEAP_NODES = {"Project", "Filter", "Relation", "LogicalRDD", "SubqueryAlias", "LocalRelation"}


def is_plain_scan(df: DataFrame) -> bool:
    """True when the optimized plan is only projections and filters over a scan."""
    tree = df._jdf.queryExecution().optimizedPlan().treeString()
    names = [re.sub(r"^[\s:+|\-]*", "", line).split(" ", 1)[0].split("[", 1)[0] for line in tree.splitlines() if line.strip()]
    return all(n in _CHEAP_NODES for n in names)


def quoted(name: str) -> Column:
    """A column by its exact name (names from file headers may hold dots or blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_type(df: DataFrame, col_name: str) -> str:
    """Type of a running sum: decimals keep the input's type (sums widen otherwise)."""
    dt = df.schema[col_name].dataType
    return dt.simpleString()
