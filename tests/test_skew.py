"""A party / statement with a third of all rows: results are exact when its ordered work is split into many buckets."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import bronze as br
from ledgerloom.operators import joins
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import scan, silver as sv
from ledgerloom.plans import fixtures as fx
from ledgerloom.schemas import LEDGER, SILVER

from conftest import SF_SMALL
from test_reconcile import evaluate


def plain_silver(bronze, fiscal_start):
    """The silver rules with plain party-wide windows (one task per statement): the reference result."""
    w = Window.partitionBy("statement_id").orderBy("line_no")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = sv.drop_blank_rows(bronze).withColumn("date", F.last("date", True).over(run))
    df = sv.drop_page_headers(sv.fiscal_filter(df, fiscal_start))
    bal = F.sum(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).over(run).cast("decimal(22,5)")
    return df.select("statement_id", F.row_number().over(w).cast("long").alias("idx"), "date", "debit", "credit",
                     bal.alias("cumulative_amount_in_local_currency"))


@pytest.fixture
def hot_bronze(spark):
    """All statements of sf0.001 appended into one statement 'HOT' plus the originals: HOT holds half the lines."""
    d = fx.dirty_statement(spark, SF_SMALL)
    w = Window.orderBy("statement_id", "line_no")
    hot = d.select(F.lit("HOT").alias("statement_id"), F.row_number().over(w).cast("long").alias("line_no"),
                   *[c for c in d.columns if c not in ("statement_id", "line_no")])
    return br.to_bronze(d.unionByName(hot))


def test_hot_statement_split_into_buckets(spark, hot_bronze, monkeypatch):
    monkeypatch.setattr(scan, "BUCKET_ROWS", 64)  # HOT's 2257 lines span 36 buckets
    got = sv.to_silver(hot_bronze, fx.FISCAL_START).select(
        "statement_id", "idx", F.col("posting_date").alias("date"), F.col("debit_amount_in_local_currency").alias("debit"),
        F.col("credit_amount_in_local_currency").alias("credit"), "cumulative_amount_in_local_currency")
    want = plain_silver(hot_bronze, fx.FISCAL_START)
    assert got.where("statement_id = 'HOT'").count() > 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_party_reconciles_like_row_by_row(spark):
    """One party with 3,000 entries next to 40 small ones (over a third of all rows), all five verdict kinds."""
    own, other = [], []
    fs = dt.date(1995, 1, 1)

    def add(party, n_entries, kind):
        a_bal = b_bal = D(0)
        own_rows, other_rows = [], []
        entries = [(k, D(k % 97 + 1) + D("0.25")) for k in range(1, n_entries + 1)]
        own_rows.append((1, "OB", D(100), None)); other_rows.append((1, "Opening Balance", None, None, D(100 + (kind == 5))))
        for k, amt in entries:
            debit = k % 4 != 0
            own_rows.append((k + 1, str(1000 + k), amt if debit else None, None if debit else amt))
            if kind == 3 and k == n_entries:
                continue
            if kind == 4 and k % 7 == 0:
                amt = amt + 1
            other_rows.append((len(other_rows) + 1, "Entry", f"INV/{1000 + k}/24" if kind != 4 or k % 3 else "NOREF",
                               None if debit else amt, amt if debit else None))
        if kind == 2:
            other_rows = other_rows[:-2]
        for idx, doc, dr, cr in own_rows:
            a_bal += (dr or 0) - (cr or 0)
            row = {c.name: None for c in LEDGER.fields}
            row.update(customer_name=party, idx=idx, posting_date=fs, origin_no=doc, debit_lc=dr, credit_lc=cr, cumulative_balance_lc=a_bal)
            own.append(tuple(row[c.name] for c in LEDGER.fields))
        for idx, part, vch, dr, cr in other_rows:
            b_bal += (cr or 0) - (dr or 0)
            other.append((party, idx, fs, part, "Sale", vch, dr, cr, b_bal))

    add("HOT", 3000, 4)
    for p in range(40):
        add(f"p{p:02d}", 5 + p % 9, p % 5 + 1)
    own_df, other_df = spark.createDataFrame(own, LEDGER), spark.createDataFrame(other, SILVER)
    r = rc.reconcile(own_df, other_df, fs.isoformat())
    got_v = {(x["party"], x["cparty"]): x["kase"] for x in r.verdict.collect()}
    got_g = sorted((tuple(x) for x in r.gold().collect()), key=str)
    want_v, want_g = evaluate([x.asDict() for x in own_df.collect()], [x.asDict() for x in other_df.collect()])
    assert got_v == want_v
    assert got_v[("HOT", "HOT")] == 4
    assert got_g == want_g
    assert any(g[0] == "HOT" for g in got_g)


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    """A per-key table is broadcast only if its rows and their bytes, nested and long values included, are under the bounds; the join is the same."""
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(7).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("y" * 500)).alias("names"))
    assert joins.bounded_small(small, "t")[1] and not joins.bounded_small(small, "t", max_rows=6)[1]
    assert joins.bounded_small(small, "t", max_bytes=20_000)[1] and not joins.bounded_small(small, "t", max_bytes=10_000)[1]
    assert joins.bounded_small(small.limit(0), "t")[1]
    hinted, plain = joins.join_per_key(big, small, "k"), joins.join_per_key(big, small, "k", max_rows=6)
    assert hinted.exceptAll(plain).count() == 0 and hinted.count() == plain.count() == 100


def test_matched_amounts(spark):
    """Equal amounts on opposite sides match, once or often; on the same side, of another pair or missing they don't."""
    schema = "party string, cparty string, idx int, debit decimal(22,5), credit decimal(22,5)"
    a = spark.createDataFrame([("p", "c", 1, D(5), None), ("p", "c", 2, D(5), None), ("p", "c", 3, None, D(7)), ("p", "c", 4, D(9), None), ("q", "c", 5, D(5), None), ("p", "c", 6, None, None), ("p", "c", 7, D(1), D(7))], schema)
    b = spark.createDataFrame([("p", "c", 1, None, D(5)), ("p", "c", 2, D(9), None), ("p", "c", 3, D(7), D(2)), ("p", "c", 4, None, None), ("q", "d", 5, None, D(5))], schema)
    own, other = rc.unmatched_by_amount(a, b)
    assert sorted(r["idx"] for r in own.collect()) == [4, 5, 6]
    assert sorted((r["party"], r["idx"]) for r in other.collect()) == [("p", 2), ("p", 4), ("q", 5)]
