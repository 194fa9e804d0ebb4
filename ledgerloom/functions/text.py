"""Text clean-up expressions (all JVM-side ``Column`` functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that OCR puts into the date cell of a statement line
DATE_NOISE = r"(Dr|Cr|By|To)"
# a month name split after its first letter ("3-J an-24"); groups: day, letter, rest of month, year
SPLIT_MONTH = r"(\d{1,2})-(\w)\s*(\w+)-(\d{2})"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """C4: remove leading and trailing white space of any kind."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    """Text that is empty after trimming is null."""
    return F.nullif(strip_ws(c), F.lit(""))


def repair_date_text(c) -> Column:
    """Drop Dr/Cr/By/To, collapse blanks, re-join a split month name, trim."""
    s = F.regexp_replace(col_(c), DATE_NOISE, "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, SPLIT_MONTH, "$1-$2$3-$4")
    return strip_ws(s)


def first_word(c) -> Column:
    """First blank-separated word ("13-Aug-24 Agst" -> "13-Aug-24")."""
    return F.split(strip_ws(c), " ").getItem(0)


def letters_only(c) -> Column:
    """Letters only, lower case; null becomes ''."""
    return F.lower(F.regexp_replace(F.coalesce(col_(c), F.lit("")), "[^a-zA-Z]", ""))


def is_thousands_number(c) -> Column:
    """A word with a comma that is all digits once the commas are removed ("1,234" but not "1,234.00")."""
    return col_(c).rlike(r"^[0-9,]*,[0-9,]*$") & col_(c).rlike("[0-9]")


def url_decoded(c) -> Column:
    """A file name as stored by the file system listing ("%23" -> "#"; a "+" stays a "+")."""
    return F.url_decode(F.replace(col_(c), F.lit("+"), F.lit("%2B")))


def file_stem(path) -> Column:
    """Base name of a path without directory and extension."""
    name = F.regexp_extract(col_(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")
