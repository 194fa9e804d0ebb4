"""R5/R6 again for the parties whose books have changed, the rest kept.

A run fingerprints both books of every party pair: number of rows and two sums of row hashes, so the order of rows and the way they are dealt out make no
difference, and a pair with a third of all rows is pre-aggregated like any other. Pairs whose fingerprint was in the last published run keep their entries; the others (changed
or new) are reconciled, and only their rows go through the verdict and the matching. Nothing stored is rewritten: a run appends the entries of its
own pairs, and a slim state (one row a pair: fingerprint, and the attempt that holds its entries) which a small record publishes
as one. Readers see the entries that the last published state names: an unpublished or failed run changes nothing, pairs that are gone leave with the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GOLD
from ..session import materialize
from . import reconcile as rc
from .joins import bounded_small

# Folders of the stored result.
ENTRIES, STATE, RUNS = "entries", "state", "runs"
PRINT = ["n_own", "sum_own", "mix_own", "n_other", "sum_other", "mix_other"]
_TEXT = T.StringType()
_STATE = T.StructType([
    *(T.StructField(k, _TEXT) for k in rc.KEYS), *(T.StructField(c, T.LongType() if c.startswith("n_") else T.DecimalType(38, 0)) for c in PRINT),
    T.StructField("holder", _TEXT), T.StructField("attempt", _TEXT),
])
_ENTRIES = T.StructType([T.StructField("cparty", _TEXT), *GOLD.fields, T.StructField("attempt", _TEXT)])
_RUN = "attempt string, published timestamp, n_pairs bigint, n_fresh bigint"


def _book_print(book: DataFrame, side: str) -> DataFrame:
    """One partial aggregate per book: order-free, and exact for repeated rows (they add up)."""
    row = [F.col(c).cast("string") for c in sorted(set(book.columns) - set(rc.KEYS))]
    row = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in row]
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)")
    return book.groupBy(*rc.KEYS).agg(
        F.count(F.lit(1)).alias(f"n_{side}"), total(F.xxhash64(*row)).alias(f"sum_{side}"), total(F.xxhash64(F.lit(side), *reversed(row))).alias(f"mix_{side}")
    )


def fingerprints(keyed: rc.Keyed) -> DataFrame:
    """(party, cparty, PRINT) of every pair that both books have."""
    return _book_print(keyed.a, "own").join(_book_print(keyed.b, "other"), rc.KEYS).select(*rc.KEYS, *PRINT)


def published(spark: SparkSession, path: str) -> str | None:
    """The last published attempt; None before the first."""
    try:
        runs = spark.read.schema(_RUN).json(f"{path}/{RUNS}")
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    last = runs.agg(F.max(F.struct("published", "attempt")).alias("r")).head()["r"]
    return last["attempt"] if last else None


def _state(spark: SparkSession, path: str, attempt: str) -> DataFrame:
    return spark.read.schema(_STATE).parquet(f"{path}/{STATE}").where(F.col("attempt") == attempt)


def reconcile_changed(ledger: DataFrame, statement: DataFrame, fiscal_start: str, path: str, books: rc.Books = rc.Books()) -> DataFrame:
    """One run over both books against what is stored below ``path``; publishes it and returns the pairs that were reconciled."""
    spark = ledger.sparkSession
    attempt, last = uuid.uuid4().hex, published(spark, path)
    keyed = rc.key_books(ledger, statement)
    now = materialize(fingerprints(keyed), "fingerprints")
    if last is None:
        state = now.withColumn("holder", F.lit(attempt))
    else:
        state = now.join(_state(spark, path, last).select(*rc.KEYS, *PRINT, "holder"), [*rc.KEYS, *PRINT], "left").withColumn("holder", F.coalesce("holder", F.lit(attempt)))
    state = materialize(state.withColumn("attempt", F.lit(attempt)), "state")
    fresh, small = bounded_small(state.where(F.col("holder") == attempt).select(*rc.KEYS), "fresh_pairs")
    some = F.broadcast(fresh) if small else fresh
    a, b = keyed.a, keyed.b
    if last is not None or not small:  # in a first run all pairs are fresh: the books are read as they are unless the join with the pairs is a shuffle
        a, b = (materialize(book.join(some, rc.KEYS, "left_semi"), f"fresh_{side}") for book, side in ((a, "own"), (b, "other")))
    part = rc.Keyed(a, b, fresh, small)
    v, small = bounded_small(rc.verdict(part, fiscal_start, books), "verdict")
    entries = rc.Reconciliation(part, v, small, books).entries()
    entries.withColumn("attempt", F.lit(attempt)).select(*_ENTRIES.names).write.mode("append").partitionBy("attempt").parquet(f"{path}/{ENTRIES}")
    state.select(*_STATE.names).write.mode("append").partitionBy("attempt").parquet(f"{path}/{STATE}")
    counts = state.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("holder") == attempt).alias("n_fresh"))
    counts.select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published"), "n_pairs", "n_fresh").coalesce(1).write.mode("append").json(f"{path}/{RUNS}")
    return fresh


def current_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all pairs as of the last published run, with their pair's counterparty name."""
    last = published(spark, path)
    if last is None:
        return spark.createDataFrame([], _ENTRIES).drop("attempt")
    holder = _state(spark, path, last).select(F.col("party").alias("customer_name"), "cparty", F.col("holder").alias("attempt"))
    return spark.read.schema(_ENTRIES).parquet(f"{path}/{ENTRIES}").join(holder, ["customer_name", "cparty", "attempt"], "left_semi").drop("attempt")
