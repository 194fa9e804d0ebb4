"""Per-party files: columns found by name in each file's own header, a missing column is an error, names from files."""

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import types as T

from ledgerloom.operators.ledger import to_ledger
from ledgerloom.schemas import SHEET_HEADER
from ledgerloom.sources.files import read_files


def write(folder, name, lines):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def row(values):
    return ",".join(f'"{v}"' if "," in v else v for v in values)


def sheet_lines(party, header, entries):
    lines = [f"Ledger of {party}", row(header)]
    for e in entries:
        lines.append(row([e.get(h, "") for h in header]))
    return lines


SCHEMA = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(SHEET_HEADER))])


def test_sheets_with_different_column_orders(spark):
    folder = tempfile.mkdtemp(prefix="ledgerloom-sheets-")
    entries = [
        {"Posting Date": "2024-04-01", "Origin No.": "OB", "Debit (LC)": "1,000.00", "Cumulative Balance (LC)": "1,000.00"},
        {"Posting Date": "2024-04-05", "Origin No.": "123.0", "Credit (LC)": "250.50", "Cumulative Balance (LC)": "749.50",
         "Details": "Sale, goods"},
    ]
    write(folder, "SAP_Bluebird Paper.csv", sheet_lines("Bluebird Paper", SHEET_HEADER, entries))
    write(folder, "SAP_Harbour#Rope.csv", sheet_lines("Harbour#Rope", list(reversed(SHEET_HEADER)), entries))
    got = {(r["customer_name"], r["idx"]): r for r in to_ledger(read_files(spark, folder, schema=SCHEMA)).collect()}
    assert set(got) == {("Bluebird Paper", 1), ("Bluebird Paper", 2), ("Harbour#Rope", 1), ("Harbour#Rope", 2)}
    for party in ("Bluebird Paper", "Harbour#Rope"):
        first, second = got[(party, 1)], got[(party, 2)]
        assert first["posting_date"] == dt.date(2024, 4, 1) and first["debit_lc"] == D("1000.00000")
        assert second["origin_no"] == "123" and second["credit_lc"] == D("250.50000")
        assert second["cumulative_balance_lc"] == D("749.50000") and second["details"] == "Sale, goods"
        assert second["debit_lc"] is None and second["ref_2"] is None


def test_missing_required_column_is_an_error(spark):
    folder = tempfile.mkdtemp(prefix="ledgerloom-sheets-")
    header = [h for h in SHEET_HEADER if h != "Credit (LC)"] + ["Remarks"]
    write(folder, "SAP_Broken.csv", sheet_lines("Broken", header, [{"Posting Date": "2024-04-01"}]))
    with pytest.raises(ValueError, match="Credit"):
        to_ledger(read_files(spark, folder, schema=SCHEMA))


STATEMENT = {"Date": "date", "Particulars": "particulars", "Vch Type": "vch_type", "Vch No.": "vch_no", "Debit": "debit", "Credit": "credit"}


def test_statements_by_their_own_header(spark, tmp_path):
    """Files with credit before debit, with other columns between, with fewer columns in the widest line's place: each by its own header."""
    from ledgerloom.sources.files import by_header

    (tmp_path / "a.csv").write_text("Date,Particulars,Vch Type,Vch No.,Debit,Credit\nd1,p1,t1,v1,1,\n")
    (tmp_path / "b.csv").write_text("Date ,Particulars, Vch Type,Vch No.,Credit,Debit\nd2,p2,t2,v2,99,\n")
    (tmp_path / "c.csv").write_text('Remarks,Date,"Notes, all",Particulars,Vch Type,Vch No.,Debit,Credit,Debit\nr,d3,n,p3,t3,v3,5,,7\n')
    rows = by_header(read_files(spark, str(tmp_path)), STATEMENT).orderBy("source_file").collect()
    assert [(r["source_file"], r["line_no"], r["date"], r["vch_no"], r["debit"], r["credit"]) for r in rows] == [
        ("a.csv", 1, "d1", "v1", "1", None), ("b.csv", 1, "d2", "v2", None, "99"), ("c.csv", 1, "d3", "v3", "5", None)
    ]
    (tmp_path / "d.csv").write_text("Date,Particulars\nd,p\n")
    with pytest.raises(ValueError, match="d.csv.*Vch Type"):
        by_header(read_files(spark, str(tmp_path)), STATEMENT, what="statement")


def test_sheets_of_unknown_width_and_date_forms(spark, tmp_path):
    def sheet(party, dates, header=SHEET_HEADER):
        entries = [{"Posting Date": d, "Due Date": "2024-01-02", "Debit (LC)": "1.00"} for d in dates]
        write(str(tmp_path), f"SAP_{party}.csv", sheet_lines(party, header, entries))

    sheet("iso", ["2024-04-01", "2024-04-01 10:00:00"], [*SHEET_HEADER, "A", "B", "C"])
    sheet("day first", ["01/04/2024", "13/04/2024", "2024-05-01"])
    sheet("month first", ["04/13/2024", "04/01/2024"])
    sheet("either", ["01/04/2024", "02/04/2024"])
    sheet("names", ["01-Apr-2024", "01.05.2024", "31/02/2024", "", "later"])
    sheet("none", [])
    lines = read_files(spark, str(tmp_path))
    got = {}
    for r in to_ledger(lines).orderBy("customer_name", "idx").collect():
        got.setdefault(r["customer_name"], []).append(str(r["posting_date"])[5:])
    assert got == {
        "iso": ["04-01", "04-01"], "day first": ["04-01", "04-13", "05-01"], "month first": ["04-13", "04-01"], "either": ["04-01", "04-02"],
        "names": ["04-01", "05-01", "", "", ""],
    }
    from ledgerloom.operators.ledger import date_report

    report = {r["source_file"]: (r["format"], r["n_values"], r["n_other"], r["ambiguous"]) for r in date_report(lines).where("column = 'posting_date'").collect()}
    assert report == {
        "SAP_iso.csv": ("yyyy-MM-dd", 2, 1, False), "SAP_day first.csv": ("d/M/yyyy", 3, 1, False), "SAP_month first.csv": ("M/d/yyyy", 2, 0, False),
        "SAP_either.csv": ("d/M/yyyy", 2, 0, True), "SAP_names.csv": ("d-MMM-yyyy", 4, 3, False),
    }


def test_bundles_hold_the_lines_of_many_files_in_few(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerloom.sources.files import by_header, write_bundles

    swapped = F.col("file") % 2 == 1
    lines = spark.range(3000).select(
        (F.col("id") % 1000).alias("file"), F.floor(F.col("id") / 1000).alias("line")
    ).select(
        F.when(F.col("file") != 999, F.concat(F.lit("temp_p"), F.col("file").cast("string"), F.lit(".csv"))).alias("source_file"), "line",
        F.when(F.col("line") == 0, F.when(swapped, "B").otherwise("A")).otherwise(F.when(swapped, "b,1").otherwise(" a\nx")).alias("_c0"),
        F.when(F.col("line") == 0, F.when(swapped, "A").otherwise("B")).otherwise(F.when(swapped, " a\nx").otherwise("b,1")).alias("_c1"),
    )
    write_bundles(lines, str(tmp_path / "bundles"), ["line"])
    assert len(list((tmp_path / "bundles").glob("**/*.csv"))) <= 100
    got = by_header(read_files(spark, str(tmp_path / "bundles"), bundled=True), {"A": "a", "B": "b"})
    rows = got.where(F.col("source_file").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("s")).collect()
    assert [tuple(r) for r in rows] == [(" a\nx", "b,1", 1998, 999 * 3)]


def test_queries_over_files_make_no_file_per_party(spark):
    import pathlib

    from __spark_entry__ import SMOKE_DIR
    from ledgerloom.plans import fixtures as fx

    for bundles in (fx.statement_bundles, fx.mixed_statement_bundles, fx.sheet_bundles):
        folder = pathlib.Path(bundles(spark, SMOKE_DIR).removeprefix("file:"))
        assert 0 < len(list(folder.glob("**/*.csv"))) < fx.own_ledger(spark, SMOKE_DIR).select("customer_name").distinct().count() / 2


def test_lines_by_header_are_numbered_once(spark, tmp_path):
    """The numbered lines are written before they are read for the headers and for the data."""
    from ledgerloom.sources.files import by_header

    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("".join(f"{x}\n" for x in ["B,A" if i == 1 else "A,B", *(f"{i}{n},x" for n in range(5))]))
    lines = read_files(spark, str(tmp_path))
    got = by_header(lines, {"A": "a", "B": "b"})
    assert "Window" in lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.orderBy("source_file", "line_no").collect()
    assert [(r["source_file"], r["line_no"], r["a"]) for r in rows] == [(f"{i}.csv", n + 1, "x" if i == 1 else f"{i}{n}") for i in range(3) for n in range(5)]
