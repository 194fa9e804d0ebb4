"""OCR pages as a stream, in any order: the silver entries equal the batch."""

from pyspark.sql import functions as F

from ledgerloom.plans import catalogue, fixtures as fx
from ledgerloom.session import scratch_path
from ledgerloom.streaming import pages as ps

from conftest import SF_SMALL


def arriving(spark, pages, name, batches):
    """The pages in files of one micro-batch each, in an order that has nothing to do with their numbers."""
    folder = scratch_path(spark, name)
    turn = F.pmod(F.xxhash64("statement_id", "page_no"), F.lit(batches))
    for i in range(batches):
        pages.where(turn == i).coalesce(1).write.mode("append").json(folder)
    return folder


def run(spark, folder, fiscal_start=fx.FISCAL_START, **options):
    out = scratch_path(spark, "page_silver")
    q = ps.start_page_stream(spark, folder, out, fiscal_start, max_files_per_trigger=1, **options)
    assert q.awaitTermination(600) and q.exception() is None
    return out


def test_shuffled_pages_give_the_batch_entries(spark):
    pages = fx.ocr_pages(spark, SF_SMALL)
    out = run(spark, arriving(spark, pages, "shuffled_pages", 3))
    want = catalogue.QUERIES["silver_entries"](spark, SF_SMALL)
    got = ps.read_entries(spark, out).drop("statement_id").select(*want.columns)
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).count() == 0
    late = ps.read_rejects(spark, out)
    assert {r["page_no"] for r in late.collect()} <= {0}  # a cover after page 1: no table, and its place is gone


def page(statement, no, lines, header=True, arrival="2024-05-01T10:00:00Z"):
    """A response with one table: the header row and lines of six texts."""
    rows = ([["Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit"]] if header else []) + lines
    blocks, cells = [], []
    for r, row in enumerate(rows, 1):
        for c, text in enumerate(row, 1):
            cell = f"c{r}-{c}"
            words = [f"{cell}/{i}" for i, _ in enumerate(text.split())]
            cells.append(cell)
            blocks.append({"Id": cell, "BlockType": "CELL", "RowIndex": r, "ColumnIndex": c, "Confidence": 99.0, "Relationships": [{"Type": "CHILD", "Ids": words}]})
            blocks += [{"Id": w, "BlockType": "WORD", "Text": t} for w, t in zip(words, text.split())]
    table = {"Id": "t", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": cells}]}
    return {"statement_id": statement, "page_no": no, "Blocks": [table, *blocks] if rows else [], "arrival": arrival}


def deliver(spark, name, batches):
    import json

    folder = scratch_path(spark, name)
    for batch in batches:
        spark.createDataFrame([(json.dumps(p),) for p in batch], "value string").coalesce(1).write.mode("append").text(folder)
    return folder


def test_gaps_redelivery_covers_and_lines_without_date(spark):
    opening = ["1-Apr-24", "Opening Balance", "Op", "0", "", "100.00"]
    sale = lambda date, no, credit: [date, "Sales", "Sales", no, "", credit]
    batches = [
        # page 3 before 1 and 2; page 2 of "late" first in another form; "none" has no header at all; a page without blocks
        [page("gap", 3, [sale("", "V4", "4.00")], header=False), page("late", 2, [sale("2-May-24", "wrong", "9.00")]), page("none", 1, [sale("2-May-24", "V1", "1.00")], header=False)],
        [page("gap", 1, [opening, sale("", "V1", "1.00"), sale("31-Mar-24", "old", "50.00")]), page("late", 2, [sale("3-May-24", "right", "5.00")], arrival="2024-05-02T10:00:00Z")],
        # frees 2 and 3: their lines without a date follow "31-Mar-24", which is before the fiscal year, until V3 has one
        [page("gap", 2, [sale("", "V2", "2.00"), sale("5-Apr-24", "V3", "3.00"), ["Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit"]], header=False), page("late", 1, [sale("1-May-24", "first", "1.00")])],
        [page("gap", 1, [sale("9-Apr-24", "again", "7.00")]), page("held", 2, [sale("9-Apr-24", "V9", "7.00")]), page("cover", 0, []), page("cover", 1, [sale("1-May-24", "V1", "1.00")])],
    ]
    out = run(spark, deliver(spark, "page_cases", batches), "2024-04-01")
    rows = ps.read_entries(spark, out).orderBy("statement_id", "idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r["statement_id"], []).append((r["idx"], str(r["posting_date"]), r["voucher_number"], float(r["cumulative_amount_in_local_currency"])))
    assert got == {
        "gap": [(1, "2024-04-01", "0", 100.0), (2, "2024-04-01", "V1", 101.0), (3, "2024-04-05", "V3", 104.0), (4, "2024-04-05", "V4", 108.0)],
        "late": [(1, "2024-05-01", "first", 1.0), (2, "2024-05-03", "right", 6.0)],
        "cover": [(1, "2024-05-01", "V1", 1.0)],
    }
    assert {tuple(r) for r in ps.read_rejects(spark, out).collect()} == {("gap", 1, ps.LATE), ("none", 1, ps.NO_HEADER)}
    assert all(r["customer_name"] == r["statement_id"] for r in rows)
