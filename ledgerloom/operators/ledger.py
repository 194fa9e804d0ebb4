"""Own-ledger sheet (ERP export, one or several files per party) -> typed ledger.

The sheet's second line is the header; columns are found by name in every file's own header line (``sources.files.by_header``).

C8: sheets write dates in different ways, and a text such as 01/04/2024 can be read in two. One pass counts, for each file, how many values each
format reads; the format that reads most is the file's, among equals one that reads the first value, then the earlier in the list. ``date_report``
lists the choice, and where it was not the only one possible.

Several sheets of one party are one book: sheets in the order of their first date (then name), lines in sheet order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import SHEET_FORMATS, date_by_format, date_readings
from ..functions.text import blank_to_null
from ..schemas import LEDGER_COLUMNS, LEDGER_DATES, LEDGER_MONEY, SHEET_HEADER
from ..session import materialize
from ..sources.files import FILE_COL, by_header, party_from_file
from .joins import join_per_key
from .names import resolve_names
from .scan import part_offsets

# The upload prefix of ERP sheets, and the header's line in the sheet
SHEET_PREFIXES = ("SAP_",)
HEADER_LINE = 2


def _choice(column: str) -> Column:
    """struct(score, -number) of the best format of a column, and how many formats are as good, from the counts and the first value's readings."""
    return F.array_max(F.transform(F.col(f"{column}_n"), lambda n, i: F.struct(n.alias("n"), F.col(f"{column}_first")[i].isNotNull().alias("first"), (-i).alias("number"))))


def _rivals(column: str, k: int):
    """Whether format i reads as many values as the chosen one, and some of them differently."""
    n, best, chosen, differs = (F.col(f"{column}_{x}") for x in ("n", "best", "format", "differs"))
    return lambda i: (n[i] == best["n"]) & (differs[chosen * k + i] > 0)


def date_formats(rows: DataFrame) -> DataFrame:
    """Per file and date column: ``<column>_format`` (number of the chosen format), ``_values``, ``_read`` (by that format), ``_rivals`` (other formats that
    read as many values, some of them differently)."""
    aggs = []
    for c in LEDGER_DATES:
        r = F.col(f"{c}_readings")
        n = F.array(*[F.count(r[i]) for i in range(len(SHEET_FORMATS))])
        differs = F.array(*[F.count(F.when(r[i] != r[j], 1)) for i in range(len(SHEET_FORMATS)) for j in range(len(SHEET_FORMATS))])
        aggs += [
            n.alias(f"{c}_n"), differs.alias(f"{c}_differs"), F.count(F.col(c)).alias(f"{c}_values"),
            F.min_by(r, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(f"{c}_first"),
        ]
    per = rows.groupBy(FILE_COL).agg(*aggs, F.count(F.lit(1)).alias("n_lines"))
    k = len(SHEET_FORMATS)
    for c in LEDGER_DATES:
        per = per.withColumn(f"{c}_best", _choice(c)).withColumn(f"{c}_format", -F.col(f"{c}_best.number"))
        rival = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), _rivals(c, k))
        per = per.withColumn(f"{c}_rivals", F.size(rival)).withColumn(f"{c}_read", F.col(f"{c}_best.n"))
    return per.select(FILE_COL, "n_lines", *[f"{c}_{x}" for c in LEDGER_DATES for x in ("format", "values", "read", "rivals")])


def sheet_rows(lines: DataFrame, header_line: int = HEADER_LINE) -> DataFrame:
    """The lines' values by name, dates with their readings; written, as the formats need a pass of their own."""
    rows = by_header(lines, dict(zip(SHEET_HEADER, LEDGER_COLUMNS)), header_line, "ledger sheet")
    rows = rows.withColumns({c: blank_to_null(c) for c in LEDGER_DATES})
    return materialize(rows.withColumns({f"{c}_readings": date_readings(c) for c in LEDGER_DATES}), "sheet_rows")


def date_report(lines: DataFrame, header_line: int = HEADER_LINE) -> DataFrame:
    """(source_file, column, format, n_values, n_other, ambiguous) of every file and date column: values that aren't in the file's format, and whether another
    format reads as many values and some of them as other dates."""
    per = date_formats(sheet_rows(lines, header_line))
    names = F.array(*[F.lit(f) for f, _ in SHEET_FORMATS])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), names[F.col(f"{c}_format")].alias("format"), F.col(f"{c}_values").alias("n_values"),
                 (F.col(f"{c}_values") - F.col(f"{c}_read")).alias("n_other"), (F.col(f"{c}_rivals") > 0).alias("ambiguous"))
        for c in LEDGER_DATES
    ])
    return per.select(FILE_COL, F.inline(rows))


def to_ledger(
    lines: DataFrame, prefixes: Sequence[str] = SHEET_PREFIXES, header_line: int = HEADER_LINE, master: DataFrame | None = None
) -> DataFrame:
    """lines: source_file, line_no, _c0.._cN (text) -> customer_name, idx and the 14 ledger columns.

    ``master``: a party master (party_name, position); the name from the file then becomes its best match there (J6), or stays if nothing is similar."""
    rows = sheet_rows(lines, header_line)
    formats = date_formats(rows)
    files = party_from_file(rows.groupBy(FILE_COL).agg(F.count(F.lit(1)).alias("n")), prefixes)
    if master is not None:
        names = resolve_names(files, "customer_name", master).select("customer_name", "party_name")
        files = join_per_key(files, names, "customer_name", "left", name="sheet_names").withColumn("customer_name", F.coalesce("party_name", "customer_name"))
    files = files.join(formats.drop("n_lines"), FILE_COL)
    rows = join_per_key(rows, files.drop("n"), FILE_COL, name="sheet_formats")
    rows = rows.withColumns({c: date_by_format(F.col(f"{c}_readings"), F.col(f"{c}_format")) for c in LEDGER_DATES})
    first = rows.groupBy("customer_name", FILE_COL).agg(F.min("posting_date").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = part_offsets(first, ["customer_name"], ["_first", FILE_COL], {"_before": "_n"}).select(FILE_COL, "_before")
    rows = join_per_key(rows, offsets, FILE_COL, name="sheet_offsets")
    out = []
    for c in LEDGER_COLUMNS:
        if c in LEDGER_MONEY:
            v = parse_amount(c)
        elif c == "origin_no":
            v = F.regexp_replace(blank_to_null(c), r"\.0$", "")  # D6: a float export's ".0" is not part of the number
        else:
            v = F.col(c) if c in LEDGER_DATES else blank_to_null(c)
        out.append(v.alias(c))
    return rows.select("customer_name", (F.col("_before") + F.col("line_no")).cast("long").alias("idx"), *out)
