"""Runs over changed parties only: same entries as a full run, only those parties reconciled, nothing seen before publication."""

import datetime as dt
from decimal import Decimal as D

from ledgerloom.operators import incremental, reconcile
from ledgerloom.schemas import GOLD_COLUMNS, SILVER
from ledgerloom.session import scratch_path

START = "2024-04-01"
LEDGER = "customer_name string, idx bigint, posting_date date, origin_no string, debit_lc decimal(22,5), credit_lc decimal(22,5), cumulative_balance_lc decimal(22,5)"


def books(spark, parties):
    """Party -> (amounts of the own book, amounts of the statement)."""
    day, own, other = dt.date(2024, 4, 1), [], []
    for p, (a, b) in parties.items():
        total = D(0)
        for i, x in enumerate(a):
            total += D(x)
            own.append((p, i + 1, day, f"D{p}{i}", D(x), None, total))
        total = D(0)
        for i, x in enumerate(b):
            total += D(x)
            other.append((p, i + 1, day, "Opening Balance" if not i else "Entry", None, f"V{p}{i}", None, D(x), total))
    return spark.createDataFrame(own, LEDGER).repartition(3), spark.createDataFrame(other, SILVER).repartition(2)


def entries(df):
    return sorted(tuple(map(str, r)) for r in df.select(*GOLD_COLUMNS).collect())


def test_runs(spark):
    path = scratch_path(spark, "incremental")
    assert incremental.current_entries(spark, path).count() == 0
    parties = {"P": ([100, 5, 7], [100, 5]), "Q": ([50, 3], [50, 3]), "R": ([10, 1, 2], [10, 1, 3]), "S": ([8, 4], [8])}
    steps = [
        (parties, {"P", "Q", "R", "S"}),
        (parties, set()),  # the same books, dealt out anew
        (parties | {"P": ([100, 5, 7], [100, 5, 7])}, {"P"}),  # now balanced: its entry goes
        ({k: v for k, v in parties.items() if k != "S"} | {"T": ([1, 2, 3], [1])}, {"P", "T"}),  # S is gone, T is new, P as at first
    ]
    for now, fresh in steps:
        own, other = books(spark, now)
        got = incremental.reconcile_changed(own, other, START, path)
        assert {r["party"] for r in got.collect()} == fresh
        assert entries(incremental.current_entries(spark, path)) == entries(reconcile.reconcile(own, other, START).gold())


def test_fingerprints_ignore_order_and_see_repeats(spark):
    own, other = books(spark, {"P": ([100, 5, 7], [100, 5])})
    prints = lambda a, b: incremental.fingerprints(reconcile.key_books(a, b)).collect()
    assert prints(own, other) == prints(own.orderBy("idx", ascending=False), other.repartition(5))
    assert prints(own, other) != prints(own.unionByName(own.where("idx = 2")), other)
    assert prints(own, other) != prints(own.replace("DP1", "DP9"), other)
