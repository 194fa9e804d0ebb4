"""Bronze lines -> silver statement with a running balance, and the closing check.

Order of the rules (as the statement is read): drop blank lines (F1), carry
the last date forward (W3), keep the fiscal year (F2), drop repeated page
headers (F3), number the remaining lines (W1), running balance credit - debit
(W4). The three ordered steps use ``ordered_scan`` on the line number, so a
statement with a third of all lines is still split over many tasks.

A party may have several statements. They are one book: statements in the order of their first date (then id), lines in file order; numbers and balance
go on from one statement to the next. It is a prefix scan in three levels, each with its totals carried to the one below: blocks of lines, statements,
party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_only
from ..schemas import MONEY
from ..session import materialize
from .joins import join_per_key
from .scan import int_bucket, ordered_scan, part_offsets

# The letters-only form of the page header cells, and the closing line text
HEADER_PARTICULARS, HEADER_VCH_NO, HEADER_VCH_TYPE = "particulars", "vchno", "vchtype"
CLOSING_TEXT = "closing balance"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def is_blank_line(date: Column, vch_no: Column, vch_type: Column) -> Column:
    """no date, no voucher number and no voucher type (totals, narration, closing line).

    The date comes last: the optimizer moves the test below the cleaning of dates, and would clean every line's date a second time for it."""
    return vch_no.isNull() & vch_type.isNull() & date.isNull()


def is_page_header(particulars: Column, vch_no: Column, vch_type: Column) -> Column:
    """a repeated page header, recognised by its letters-only cells."""
    return (
        (letters_only(particulars) == HEADER_PARTICULARS)
        & (letters_only(vch_no) == HEADER_VCH_NO)
        & (letters_only(vch_type) == HEADER_VCH_TYPE)
    )


def is_opening_line(particulars: Column) -> Column:
    """the line that states the opening balance."""
    return F.lower(particulars).like("op%bal%")


def drop_blank_rows(bronze: DataFrame) -> DataFrame:
    return bronze.where(~is_blank_line(F.col("date"), F.col("vch_no"), F.col("vch_type")))


def fill_dates(bronze: DataFrame) -> DataFrame:
    """Forward fill of the date in file order within a statement (leading nulls stay)."""
    return ordered_scan(
        bronze, ["statement_id"], ["line_no"], fills={"_date": F.col("date")}, bucket=int_bucket("line_no")
    ).withColumn("date", F.col("_date")).drop("_date")


def fiscal_filter(df: DataFrame, fiscal_start: str, col: str = "date") -> DataFrame:
    """keep lines from the fiscal start; lines without a date drop out."""
    return df.where(F.col(col) >= F.lit(fiscal_start).cast("date"))


def drop_page_headers(df: DataFrame) -> DataFrame:
    return df.where(~is_page_header(F.col("particulars"), F.col("vch_no"), F.col("vch_type")))


def number_lines(df: DataFrame, out: str = "idx") -> DataFrame:
    """1-based position of every remaining line in file order, per statement."""
    return ordered_scan(df, ["statement_id"], ["line_no"], row_number=out, bucket=int_bucket("line_no"))


def running_balance(df: DataFrame, keys, order: str, debit: str, credit: str, out: str) -> DataFrame:
    """Running credit - debit (null = 0) in file order, exact decimals."""
    value = F.coalesce(F.col(credit), _zero()) - F.coalesce(F.col(debit), _zero())
    return ordered_scan(df, keys, [order], sums={out: value}, bucket=int_bucket(order)).withColumn(
        out, F.col(out).cast(MONEY)
    )


def to_silver(bronze: DataFrame, fiscal_start: str, names: DataFrame | None = None) -> DataFrame:
    """R2: bronze -> silver statement (customer_name, idx, posting_date, particulars, voucher_type,
    voucher_number, debit/credit/cumulative_amount_in_local_currency, statement_id).

    ``names``: optional (customer_name, party_name) resolution table (J6); the
    statement's own party name is kept where it has no entry. ``idx`` is unique in a party. The opening line of a party's second or later statement restates
    the balance that is carried into it, so it adds nothing."""
    df = drop_page_headers(fiscal_filter(fill_dates(drop_blank_rows(bronze)), fiscal_start))
    if names is not None:
        df = join_per_key(df, names, "customer_name", "left", name="silver_names").withColumn(
            "customer_name", F.coalesce("party_name", "customer_name")
        ).drop("party_name")
    value = F.coalesce(F.col("credit"), _zero()) - F.coalesce(F.col("debit"), _zero())
    df = materialize(df.withColumns({"_value": value.cast(MONEY), "_opens": F.coalesce(is_opening_line(F.col("particulars")), F.lit(False))}), "silver_lines")
    parts = df.groupBy("customer_name", "statement_id").agg(
        F.min("date").alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(~F.col("_opens"), F.col("_value"))).cast(MONEY).alias("_rest"), F.sum("_value").cast(MONEY).alias("_all"),
    )
    # the first statement's total has its opening line, the others' don't
    parts = part_offsets(parts, ["customer_name"], ["_first", "statement_id"], {})
    parts = parts.withColumn("_total", F.when(F.col("_part") == 1, F.col("_all")).otherwise(F.coalesce("_rest", _zero())).cast(MONEY))
    parts = part_offsets(parts, ["customer_name"], ["_first", "statement_id"], {"_lines_before": "_n", "_balance_before": "_total"})
    parts = parts.select("customer_name", "statement_id", "_part", "_lines_before", "_balance_before")
    parts = parts.withColumnsRenamed({"customer_name": "_party", "statement_id": "_statement"})
    on = lambda b, p: b["customer_name"].eqNullSafe(p["_party"]) & b["statement_id"].eqNullSafe(p["_statement"])
    df = join_per_key(df, parts, on, name="statement_parts").drop("_party", "_statement")
    # W1 and W4 share key and order: one scan numbers the lines and carries the balance
    df = ordered_scan(
        df, ["customer_name", "statement_id"], ["line_no"], row_number="_line",
        sums={"_balance": F.when(F.col("_opens") & (F.col("_part") > 1), _zero()).otherwise(F.col("_value"))}, bucket=int_bucket("line_no"), cheap=True,
    )
    df = df.withColumns({
        "idx": F.col("_lines_before") + F.col("_line"),
        "cumulative_amount_in_local_currency": (F.col("_balance_before") + F.col("_balance")).cast(MONEY),
    })
    return df.select(
        "customer_name", "idx", F.col("date").alias("posting_date"), "particulars",
        F.col("vch_type").alias("voucher_type"), F.col("vch_no").alias("voucher_number"),
        F.col("debit").alias("debit_amount_in_local_currency"),
        F.col("credit").alias("credit_amount_in_local_currency"),
        "cumulative_amount_in_local_currency", "statement_id",
    )


def closing_line(bronze: DataFrame) -> DataFrame:
    """Value of the last 'closing balance' line of every statement (debit, else credit)."""
    return (
        bronze.where(F.lower(F.trim(F.col("particulars"))) == CLOSING_TEXT)
        .groupBy("statement_id")
        .agg(F.max_by(F.coalesce("debit", "credit"), "line_no").alias("stated_closing"))
    )


def closing_check(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Stated closing balance vs. the last running balance, per statement."""
    computed = silver.groupBy("statement_id").agg(
        F.max_by("cumulative_amount_in_local_currency", "idx").alias("computed_closing")
    )
    stated = closing_line(bronze)
    ids = bronze.select("statement_id").distinct()
    return (
        ids.join(stated, "statement_id", "left")
        .join(computed, "statement_id", "left")
        .select(
            "statement_id", "stated_closing", "computed_closing",
            F.coalesce(F.col("stated_closing") == F.col("computed_closing"), F.lit(False)).alias("closing_ok"),
        )
    )
