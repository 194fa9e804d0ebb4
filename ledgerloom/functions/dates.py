"""Date parsing with the two statement formats, null on anything else."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, first_word, repair_date_text

# Statement date formats, tried in this order ("13-Aug-24", then "1-4-2024")
STATEMENT_FORMATS = ("d-MMM-yy", "d-M-yyyy")
# and how every text ends that they can read: other texts aren't tried, as a failed try costs many times a good one
STATEMENT_ENDS = (r"-\D{3}-[0-9]{2}$", r"[0-9]-[+-]?[0-9]{4,}$")
# ERP export formats (ISO date, ISO timestamp)
ERP_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
# All forms a sheet's dates may have, in order of preference where several fit, each with the shape of its text; day before month comes first
SHEET_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
)
# Two-digit years 69..99 are 1969..1999, 00..68 are 2000..2068 (POSIX pivot)
PIVOT_YEAR = 2069


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it (branches of ``when`` would compute it again)."""
    return F.transform(F.array(value), use)[0]


def pivot_two_digit_year(d: Column) -> Column:
    """Spark reads 'yy' as 20yy; move 2069..2099 back a century."""
    return F.when(F.year(d) >= PIVOT_YEAR, F.add_months(d, -1200)).otherwise(d)


def parse_statement_date(c) -> Column:
    """First word of the repaired text as d-MMM-yy, else d-M-yyyy, else null."""

    def read(word: Column) -> Column:
        short, long = (F.when(word.rlike(end), F.try_to_date(word, f)) for f, end in zip(STATEMENT_FORMATS, STATEMENT_ENDS))
        return F.coalesce(once(short, pivot_two_digit_year), long)

    return once(first_word(col_(c)), read)


def clean_statement_date(c) -> Column:
    """C1-C6 in one expression: raw OCR date text -> date or null."""
    return parse_statement_date(repair_date_text(col_(c)))


def date_text(d) -> Column:
    """The dd-MM-yyyy text form of a date."""
    return F.date_format(col_(d), "dd-MM-yyyy")


def parse_erp_date(c, formats: Sequence[str] = ERP_FORMATS) -> Column:
    """First format that parses, else null."""
    s = F.trim(col_(c))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])


def date_readings(c, formats: Sequence[tuple[str, str]] = SHEET_FORMATS) -> Column:
    """The date that each format reads the text as, null where it doesn't fit. The shape is looked at first, so few formats are tried on a text."""
    return once(F.trim(col_(c)), lambda s: F.array(*[F.when(s.rlike(shape), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for f, shape in formats]))


def date_by_format(readings: Column, chosen: Column) -> Column:
    """The reading by the file's format (its number, from 0); a text that doesn't fit it counts if all formats it fits agree on one date."""
    others = F.array_distinct(F.filter(readings, lambda d: d.isNotNull()))
    return F.coalesce(F.try_element_at(readings, chosen + 1), F.when(F.size(others) == 1, F.try_element_at(others, F.lit(1))))
