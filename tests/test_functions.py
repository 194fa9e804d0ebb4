"""Scalar functions: date repair/parse, amounts, text, similarity (edge cases of SURVEY §2.9 / FIXTURES §2)."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions.amounts import nan_to_null, parse_amount
from ledgerloom.functions.dates import clean_statement_date, date_text, parse_erp_date
from ledgerloom.functions.similarity import lcs_length, similarity
from ledgerloom.functions.text import file_stem, is_thousands_number, letters_only, repair_date_text


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("13-Aug-24 Agst", dt.date(2024, 8, 13)),
    ("To 3-Aug-24", dt.date(2024, 8, 3)),
    ("3-J an-24", dt.date(2024, 1, 3)),
    ("3-Ja n-24", None),
    ("1-4-2024", dt.date(2024, 4, 1)),
    ("  01-04-2024 ", dt.date(2024, 4, 1)),
    ("13-Aug-99", dt.date(1999, 8, 13)),
    ("13-AUG-69", dt.date(1969, 8, 13)),
    ("5-Jan-68", dt.date(2068, 1, 5)),
    ("31-Feb-24", None),
    ("13-Sept-24", None),
    ("1-4-24", None),
    ("", None),
    (None, None),
    ("By 12-Dec-23 Dr", dt.date(2023, 12, 12)),
])
def test_statement_dates(spark, text, expected):
    assert one(spark, clean_statement_date, text) == expected


def test_repair_date_text(spark):
    assert one(spark, repair_date_text, "To  05-J an-95   Agst ") == "05-Jan-95 Agst"
    assert one(spark, repair_date_text, "  1-4-1995 ") == "1-4-1995"


@pytest.mark.parametrize("text,expected", [
    ("1,234.50 Dr", Decimal("1234.50000")),
    ("(100)", Decimal("100.00000")),
    ("5.", Decimal("5.00000")),
    (".5", Decimal("0.50000")),
    ("-", None), ("", None), ("1.2.3", None), ("12-", None), (None, None),
    ("-12.5", Decimal("-12.50000")),
])
def test_amounts(spark, text, expected):
    assert one(spark, parse_amount, text) == expected


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()] == [None, 1.5, None]


def test_date_text_and_erp_dates(spark):
    assert one(spark, date_text, dt.date(2024, 4, 1), "date") == "01-04-2024"
    assert one(spark, parse_erp_date, "2024-04-01") == dt.date(2024, 4, 1)
    assert one(spark, parse_erp_date, "2024-04-01 00:00:00") == dt.date(2024, 4, 1)
    assert one(spark, parse_erp_date, "garbage") is None


def test_text_helpers(spark):
    assert one(spark, letters_only, "Vch No. ") == "vchno"
    assert one(spark, letters_only, None) == ""
    assert one(spark, is_thousands_number, "1,234") is True
    assert one(spark, is_thousands_number, "1,234.00") is False
    assert one(spark, is_thousands_number, "abc,") is False
    assert one(spark, file_stem, "/a/b/temp_Bluebird Paper.csv") == "temp_Bluebird Paper"


def lcs_py(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def ratio_py(a, b):
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    if not a or not b:
        return 0
    return int(round(100 * (2 * lcs_py(a, b) / (len(a) + len(b)))))


PAIRS = [("kitten", "sitting"), ("temp_BLUEBIRD.csv", "Bluebird Paper"), ("", "x"), ("abc", "abc"),
         ("Acme North Ahm", "Acme North Guj"), ("D.B. Metals Dahej", "D.B. Metals Ahm"), ("ab", "ba"),
         ("x", "y"), ("aaaa", "aa"), ("Quarry", "Harbour Rope")]


def test_similarity_matches_python(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    got = df.select("a", "b", lcs_length("a", "b").alias("l"), similarity("a", "b").alias("s")).collect()
    for r in got:
        assert r["l"] == lcs_py(r["a"], r["b"]), r
        assert r["s"] == ratio_py(r["a"], r["b"]), r


def test_lcs_random_pairs_both_forms(spark):
    import random

    from ledgerloom.functions.similarity import lcs_table

    rnd = random.Random(7)
    pairs = []
    for _ in range(150):
        la, lb = rnd.choice([0, 1, 3, 9, 20, 40, 61, 62, 63, 70]), rnd.choice([1, 2, 8, 18, 62, 63, 80])
        alphabet = rnd.choice(["ab", "abc", "abcdefgh", "ABab .#"])
        pairs.append(("".join(rnd.choice(alphabet) for _ in range(la)), "".join(rnd.choice(alphabet) for _ in range(lb))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", lcs_length("a", "b").alias("l"), lcs_table("a", "b").alias("t"), similarity("a", "b").alias("s")).collect()
    for r in got:
        want = lcs_py(r["a"], r["b"]) if r["a"] and r["b"] else 0
        assert r["l"] == want, (r["a"], r["b"])
        assert (r["t"] if r["a"] and r["b"] else 0) == want
        assert r["s"] == ratio_py(r["a"], r["b"])


def test_similarity_to_fixed_equals_similarity(spark):
    from ledgerloom.functions.similarity import similarity_to_fixed

    names = ["Bluebird Paper", "D.B. Metals Ahm", "x" * 70, "", "aab"]
    df = spark.createDataFrame([(a,) for a, _ in PAIRS] + [("temp_BLUEBIRD.csv",), ("x" * 65,), ("",)], "a string")
    got = df.select("a", *[similarity_to_fixed(F.col("a"), n).alias(f"s{i}") for i, n in enumerate(names)]).collect()
    for r in got:
        for i, n in enumerate(names):
            assert r[f"s{i}"] == ratio_py(r["a"], n), (r["a"], n)


def test_a_date_text_is_repaired_once(spark):
    """The repair is named once in the plan of a parsed date, not in each branch that looks at it."""
    plan = spark.createDataFrame([("13-Aug-24",)], "t string").select(clean_statement_date("t").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(Dr|Cr|By|To)") == 1


def test_a_sheet_date_is_computed_once_for_all_formats(spark):
    df = spark.createDataFrame([("01/04/2024",), (None,), (" 2024-01-13 ",)], "t string").select(dates.date_readings(F.regexp_replace("t", "#", "")).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    got = [[str(d) for d in r["r"] if d] for r in df.collect()]
    assert got == [["2024-04-01", "2024-01-04"], [], ["2024-01-13"]]


def test_statement_dates_are_tried_only_where_they_can_fit(spark):
    """The texts that are not tried are those that no format reads; most lines of a statement are among them."""
    days, months = ["1", "01", "13", "31", "0", "+1", "-1", "001", "x", ""], ["Aug", "AUG", "aug", "Sept", "August", "8", "08", "13", "+8", "-8", "A"]
    years = ["24", "70", "2024", "024", "02024", "+12024", "-2024", "4", "", "20 24", "24x"]
    texts = [f"{d}-{m}-{y}" for d in days for m in months for y in years] + ["", "-", "Date", "Total", "2024-01-13", "13/08/2024", "13-Aug-24-", None, "13-Aug-24\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    w = F.split(F.regexp_replace("t", r"^\s+|\s+$", ""), " ").getItem(0)
    plain = F.coalesce(dates.pivot_two_digit_year(F.try_to_date(w, "d-MMM-yy")), F.try_to_date(w, "d-M-yyyy"))
    rows = df.select("t", dates.parse_statement_date("t").cast("string").alias("got"), plain.cast("string").alias("want")).collect()
    assert [(r["t"], r["got"]) for r in rows if r["got"] != r["want"]] == []
    assert sum(r["got"] is not None for r in rows) > 20
    for text in ("", "Date", "Total"):
        assert not any(re.search(end, text) for end in dates.STATEMENT_ENDS)


def test_blank_text_is_null_and_trimmed_once(spark):
    from ledgerloom.functions.text import blank_to_null

    rows = spark.createDataFrame([(" a b\t",), (" \n",), ("",), (None,), ("x",)], "t string").select(blank_to_null("t").alias("t"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["t"] for r in rows.collect()] == ["a b", None, None, None, "x"]
