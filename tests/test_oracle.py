"""Every catalogue query against its DuckDB oracle on sf0.001 (row count, columns, order-insensitive values)."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalogue
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(cols) == sorted(o_cols)
    assert len(rows) == len(o_rows)
    assert canon(cols, rows) == canon(o_cols, o_rows)


@pytest.mark.parametrize("name", ["header_clean", "ocr_bronze", "ocr_redelivery", "ocr_rows", "page_concat"])
def test_pages_match_oracle_on_more_statements(spark, name):
    """Statements of this size have pages without a header that begin with a repeated header line."""
    sf = SF_SMALL.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer_name", "posting_date", "invoice_number", "amount_in_local_currency", "flag"]
    assert df.count() == 280
