"""Fixed schemas of the engine's tables.

Money is exact: ``decimal(22,5)`` everywhere, so balances compare with ``=``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(22, 5)
MONEY_SQL = "decimal(22,5)"

# --- OCR block as returned by a table-extraction service (one JSON document per page)
RELATIONSHIP = T.StructType([
    T.StructField("Type", T.StringType()),
    T.StructField("Ids", T.ArrayType(T.StringType())),
])
BLOCK = T.StructType([
    T.StructField("Id", T.StringType()),
    T.StructField("BlockType", T.StringType()),
    T.StructField("RowIndex", T.IntegerType()),
    T.StructField("ColumnIndex", T.IntegerType()),
    T.StructField("Confidence", T.DoubleType()),
    T.StructField("Text", T.StringType()),
    T.StructField("SelectionStatus", T.StringType()),
    T.StructField("Relationships", T.ArrayType(RELATIONSHIP)),
])
OCR_PAGE = T.StructType([
    T.StructField("statement_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("Blocks", T.ArrayType(BLOCK)),
])

# Fixed values from here on: column names of the statement, sheet, silver and gold tables.
# --- Bronze statement: the cleaned counterparty table, still text where the source was text
BRONZE_HEADER = ["Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit"]
BRONZE_COLUMNS = ["date", "particulars", "vch_type", "vch_no", "debit", "credit"]
BRONZE = T.StructType([
    T.StructField("statement_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("particulars", T.StringType()),
    T.StructField("vch_type", T.StringType()),
    T.StructField("vch_no", T.StringType()),
    T.StructField("debit", MONEY),
    T.StructField("credit", MONEY),
    T.StructField("customer_name", T.StringType()),
])

# --- Silver statement (book B) with its running balance credit - debit
SILVER = T.StructType([
    T.StructField("customer_name", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("posting_date", T.DateType()),
    T.StructField("particulars", T.StringType()),
    T.StructField("voucher_type", T.StringType()),
    T.StructField("voucher_number", T.StringType()),
    T.StructField("debit_amount_in_local_currency", MONEY),
    T.StructField("credit_amount_in_local_currency", MONEY),
    T.StructField("cumulative_amount_in_local_currency", MONEY),
])

# --- Own ledger (book A), the ERP export; the balance is given by the ERP (debit - credit)
SHEET_HEADER = [
    "Posting Date", "Due Date", "Trans. No.", "Offset Account", "Origin", "Origin No.",
    "Ref. 2", "Details", "Debit (LC)", "Credit (LC)", "Cumulative Balance (LC)",
    "Balance Due (LC)", "Created By", "Branch",
]
LEDGER_COLUMNS = [
    "posting_date", "due_date", "trans_no", "offset_account", "origin", "origin_no",
    "ref_2", "details", "debit_lc", "credit_lc", "cumulative_balance_lc",
    "balance_due_lc", "created_by", "branch",
]
LEDGER_MONEY = ["debit_lc", "credit_lc", "cumulative_balance_lc", "balance_due_lc"]
LEDGER_DATES = ["posting_date", "due_date"]
LEDGER = T.StructType(
    [T.StructField("customer_name", T.StringType()), T.StructField("idx", T.LongType())]
    + [
        T.StructField(c, T.DateType() if c in LEDGER_DATES else MONEY if c in LEDGER_MONEY else T.StringType())
        for c in LEDGER_COLUMNS
    ]
)

# --- Gold: unmatched entries
GOLD = T.StructType([
    T.StructField("customer_name", T.StringType()),
    T.StructField("posting_date", T.DateType()),
    T.StructField("invoice_number", T.StringType()),
    T.StructField("amount_in_local_currency", MONEY),
    T.StructField("flag", T.StringType()),
])
GOLD_COLUMNS = [f.name for f in GOLD.fields]

# --- Party master
PARTY_MASTER = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("party_name", T.StringType()),
])
