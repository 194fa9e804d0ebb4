"""Inputs of the query catalogue, derived by Spark from the testdata tables.

The reference ships no sample books, so the two books of every party are
derived from ``orders`` and ``customer`` (one party per customer), with five
planted scenarios (``custkey % 5``): balanced, extra entries in the own
ledger, extra entries in the counterparty statement, diverged books, and a
differing opening balance. All derivations are joins, aggregates and ordered
scans that grow with the tables; nothing is generated on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_per_key
from ..operators.scan import int_bucket, ordered_scan
from ..schemas import MONEY, OCR_PAGE
from ..session import materialize, read_table
from .responses import deliveries, responses

# Fixed values of the fixture: the first posting date (the earliest order date, so nothing is cut)
FISCAL_START = "1995-01-01"
# and the fiscal start used by the fiscal_filter query.
FISCAL_FILTER_START = "1997-01-01"

_cache: dict[tuple, DataFrame] = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since the fiscal start with their customer, position ``rn`` and count ``n`` per customer."""

    def build():
        orders = (
            read_table(spark, sf_dir, "orders")
            .where(F.col("o_orderdate") >= F.lit(FISCAL_START).cast("timestamp_ntz"))
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        )
        customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        base = join_per_key(orders, customers, lambda o, c: o.o_custkey == c.c_custkey, name="fx_customer").select(
            F.col("c_name").alias("party"),
            F.col("c_custkey").alias("k"),
            F.col("o_orderdate").cast("date").alias("posting_date"),
            F.col("o_orderkey").alias("ok"),
            F.col("o_totalprice").cast(MONEY).alias("amt"),
        )
        # written once, in ranges: the scan and the counts read the same rows, and most of a customer's are together
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        base = base.repartitionByRange(ranges, "k", "posting_date", "ok").withColumn("range", F.spark_partition_id().cast("long"))
        base = materialize(base, "fx_ranges")
        counts = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        base = ordered_scan(base, ["k"], ["posting_date", "ok"], row_number="rn", bucket=F.col("range"), cheap=True).drop("range")
        return materialize(join_per_key(base, counts, "k", name="fx_counts"), "fx_base")

    return _memo(spark, sf_dir, "base", build)


def opening_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        base = base_orders(spark, sf_dir)
        op = (
            read_table(spark, sf_dir, "customer")
            .join(base.select(F.col("k").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
            .select(
                F.col("c_name").alias("party"),
                F.col("c_custkey").alias("k"),
                F.abs("c_acctbal").cast(MONEY).alias("amt"),
            )
        )
        # one row a customer, written: both books are read more than once as projections of written tables
        return materialize(op, "fx_opening")

    return _memo(spark, sf_dir, "op", build)


def own_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book A: customer_name, idx, posting_date, origin_no, debit_lc, credit_lc, cumulative_balance_lc."""

    def build():
        base = base_orders(spark, sf_dir)
        op = opening_amounts(spark, sf_dir)
        # some parties have a longer name in the own book than in the counterparty's
        party = F.concat("party", F.when(F.col("k") % 9 == 4, F.lit(" (Head Office)")).otherwise(F.lit(""))).alias("party")
        opening = op.select(
            party, "k", F.lit(0).cast("long").alias("seq"), F.lit(FISCAL_START).cast("date").alias("posting_date"),
            F.lit("OB").alias("doc_no"), F.col("amt").alias("debit"), F.lit(None).cast(MONEY).alias("credit"), F.lit(False).alias("unknown"),
        )
        # and some rows, a party's last one among them, have no balance
        unknown = (F.col("k") % 10 == 5) & ((F.col("rn") == F.col("n")) | (F.col("rn") == 2))
        entries = base.where(~((F.col("k") % 5 == 2) & (F.col("rn") > F.col("n") - 2))).select(
            party, "k", F.col("rn").alias("seq"), "posting_date", F.col("ok").cast("string").alias("doc_no"),
            F.when(F.col("ok") % 4 != 0, F.col("amt")).alias("debit"),
            F.when(F.col("ok") % 4 == 0, F.col("amt")).alias("credit"), unknown.alias("unknown"),
        )
        rows = opening.unionByName(entries)
        rows = ordered_scan(
            rows, ["party"], ["seq"], row_number="idx",
            sums={"bal": F.coalesce("debit", F.lit(0).cast(MONEY)) - F.coalesce("credit", F.lit(0).cast(MONEY))},
            bucket=int_bucket("seq"), cheap=True,
        )
        return materialize(
            rows.select(
                F.col("party").alias("customer_name"), "idx", "posting_date",
                F.col("doc_no").alias("origin_no"),
                F.col("debit").alias("debit_lc"), F.col("credit").alias("credit_lc"),
                F.when(~F.col("unknown"), F.col("bal")).cast(MONEY).alias("cumulative_balance_lc"),
            ),
            "fx_own",
        )

    return _memo(spark, sf_dir, "own", build)


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book B before numbering: party, k, seq, posting_date, particulars, voucher_type, voucher_number, debit, credit."""

    def build():
        base = base_orders(spark, sf_dir)
        op = opening_amounts(spark, sf_dir)
        one = F.lit(1).cast(MONEY)
        opening = op.select(
            "party", "k", F.lit(0).cast("long").alias("seq"), F.lit(FISCAL_START).cast("date").alias("posting_date"),
            F.lit("Opening Balance").alias("particulars"), F.lit(None).cast("string").alias("voucher_type"),
            F.lit(None).cast("string").alias("voucher_number"), F.lit(None).cast(MONEY).alias("debit"),
            F.when(F.col("k") % 5 == 4, F.col("amt") + one).otherwise(F.col("amt")).cast(MONEY).alias("credit"),
        )
        s3 = F.col("k") % 5 == 3
        amt = F.when(s3 & (F.col("ok") % 5).isin(1, 3), F.col("amt") + one).otherwise(F.col("amt")).cast(MONEY)
        voucher = F.when(s3 & (F.col("ok") % 5).isin(2, 3), F.lit("NOREF")).otherwise(
            F.concat(F.lit("INV/"), F.col("ok").cast("string"), F.lit("/24"))
        )
        dropped = ((F.col("k") % 5 == 1) & (F.col("rn") > F.col("n") - 2)) | (s3 & (F.col("ok") % 3 == 0) & (F.col("rn") > 1))
        entries = base.where(~dropped).select(
            "party", "k", F.col("rn").alias("seq"), "posting_date", F.lit("Entry").alias("particulars"),
            F.lit("Sale").alias("voucher_type"), voucher.alias("voucher_number"),
            F.when(F.col("ok") % 4 == 0, amt).alias("debit"), F.when(F.col("ok") % 4 != 0, amt).alias("credit"),
        )
        return opening.unionByName(entries)

    return _memo(spark, sf_dir, "stmt_lines", build)


def counterparty_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book B (silver form): customer_name, idx, posting_date, particulars, voucher_type, voucher_number,
    debit/credit/cumulative_amount_in_local_currency (running credit - debit)."""

    def build():
        rows = ordered_scan(
            statement_lines(spark, sf_dir), ["party"], ["seq"], row_number="idx",
            sums={"bal": F.coalesce("credit", F.lit(0).cast(MONEY)) - F.coalesce("debit", F.lit(0).cast(MONEY))},
            bucket=int_bucket("seq"), cheap=True,
        )
        return materialize(
            rows.select(
                F.col("party").alias("customer_name"), "idx", "posting_date", "particulars", "voucher_type",
                "voucher_number",
                F.col("debit").alias("debit_amount_in_local_currency"),
                F.col("credit").alias("credit_amount_in_local_currency"),
                F.col("bal").cast(MONEY).alias("cumulative_amount_in_local_currency"),
            ),
            "fx_counterparty",
        )

    return _memo(spark, sf_dir, "counterparty", build)


# ---------------------------------------------------------------- dirty statement (FIXTURES §5)

# Month abbreviations in calendar order, as printed on statements
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
# the repeated page header, the narration text and the closing line of a statement
PAGE_HEADER = ("Date ", "Particulars ", "Vch Type ", "Vch No. ", "Debit ", "Credit ")
NARRATION = "Being goods sold "
CLOSING = "Closing Balance "


def amount_text(x) -> F.Column:
    """Two decimals, a comma before the last six characters when seven or longer."""
    s = x.cast("decimal(20,2)").cast("string")
    n = F.length(s)
    return F.when(n >= 7, F.concat(s.substr(F.lit(1), n - 6), F.lit(","), s.substr(n - 5, F.lit(6)))).otherwise(s)


def _date_text(seq, d) -> F.Column:
    mon = F.lit(MONTHS).substr((F.month(d) - 1) * 3 + 1, F.lit(3))
    mon = F.when(seq % 4 == 0, F.concat(mon.substr(1, 1), F.lit(" "), mon.substr(2, 2))).otherwise(mon)
    short = F.concat(
        F.lit("To "), F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lit("-"), mon, F.lit("-"),
        F.lpad((F.year(d) % 100).cast("string"), 2, "0"), F.lit(" Agst "),
    )
    long_ = F.concat(
        F.lit("  "), F.dayofmonth(d).cast("string"), F.lit("-"), F.month(d).cast("string"), F.lit("-"),
        F.year(d).cast("string"), F.lit(" "),
    )
    return F.when(seq % 3 == 2, F.lit("")).when(seq % 2 == 0, short).otherwise(long_)


def dirty_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterparty statements as OCR'd text: statement_id, line_no, date, particulars, vch_type, vch_no, debit, credit.

    Entries with noisy dates and amounts, repeated page headers, narration lines and a closing line."""

    def build():
        lines = statement_lines(spark, sf_dir)
        seq = F.col("seq")
        sp = lambda c: F.concat(F.col(c), F.lit(" "))
        entries = lines.select(
            F.col("party").alias("statement_id"), (seq * 10).alias("ord"),
            _date_text(seq, F.col("posting_date")).alias("date"), sp("particulars").alias("particulars"),
            sp("voucher_type").alias("vch_type"), sp("voucher_number").alias("vch_no"),
            F.concat(amount_text(F.col("debit")), F.lit(" Dr")).alias("debit"),
            F.concat(amount_text(F.col("credit")), F.lit(" Cr")).alias("credit"),
        )
        headers = lines.where((seq > 0) & (seq % 5 == 0)).select(
            F.col("party").alias("statement_id"), (seq * 10 - 1).alias("ord"),
            *[F.lit(t).alias(c) for t, c in zip(PAGE_HEADER, ["date", "particulars", "vch_type", "vch_no", "debit", "credit"])],
        )
        narration = lines.where(seq % 4 == 1).select(
            F.col("party").alias("statement_id"), (seq * 10 + 1).alias("ord"), F.lit("").alias("date"),
            F.lit(NARRATION).alias("particulars"),
            *[F.lit(None).cast("string").alias(c) for c in ["vch_type", "vch_no", "debit", "credit"]],
        )
        # the last running balance is the sum of the lines
        value = F.coalesce("credit", F.lit(0).cast(MONEY)) - F.coalesce("debit", F.lit(0).cast(MONEY))
        last = lines.where(F.col("party").isNotNull()).groupBy(F.col("party").alias("customer_name")).agg(
            F.sum(value).cast(MONEY).alias("bal"), F.max("seq").alias("last")
        )
        k = F.substring(F.col("customer_name"), -9, 9).cast("long")
        closing = last.select(
            F.col("customer_name").alias("statement_id"), (F.col("last") * 10 + 2).alias("ord"),
            F.lit("").alias("date"), F.lit(CLOSING).alias("particulars"),
            F.lit(None).cast("string").alias("vch_type"), F.lit(None).cast("string").alias("vch_no"),
            F.when(F.col("bal") >= 0, F.concat(amount_text(F.col("bal") + F.when(k % 10 == 7, 1).otherwise(0)), F.lit(" Dr"))).alias("debit"),
            F.when(F.col("bal") < 0, F.concat(amount_text(-F.col("bal")), F.lit(" Cr"))).alias("credit"),
        )
        rows = entries.unionByName(headers).unionByName(narration).unionByName(materialize(closing, "fx_closing"))
        rows = ordered_scan(rows, ["statement_id"], ["ord"], row_number="line_no", bucket=int_bucket("ord"), cheap=True)
        return materialize(
            rows.select("statement_id", "line_no", "date", "particulars", "vch_type", "vch_no", "debit", "credit"),
            "fx_dirty",
        )

    return _memo(spark, sf_dir, "dirty", build)


# ---------------------------------------------------------------- names (FIXTURES §8)


def party_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party master: distinct part names, list position by name."""
    return read_table(spark, sf_dir, "part").select(F.col("p_name").alias("party_name")).where(
        F.col("party_name").isNotNull()
    ).distinct()


def dirty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, raw_name): a file name, the name without 'e', upper case, the first five letters."""
    p = F.col("p_name")
    variants = F.array(F.concat(F.lit("temp_"), p, F.lit(".csv")), F.replace(p, F.lit("e"), F.lit("")), F.upper(p), F.substring(p, 1, 5))
    return (
        read_table(spark, sf_dir, "part").where(p.isNotNull())
        .select(p.alias("source_name"), F.explode(variants).alias("raw_name"))
        .distinct()
    )


# ---------------------------------------------------------------- files (FIXTURES §5 as CSV, §7)

# Fixed values of the sheet fixture: constant text columns and the upload prefixes of the two kinds of file
SHEET_CONSTANTS = {"offset_account": "ACC-1", "origin": "IN", "details": "Sale, goods", "created_by": "user", "branch": "Main"}
STATEMENT_PREFIX = "temp_"
SHEET_PREFIX = "SAP_"


def statement_files(spark: SparkSession, sf_dir: str) -> str:
    """The dirty statements as one CSV per party (header row as printed), under the checkpoint folder."""
    from ..sources.files import write_files
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "statement_files")
        write_files(printed_statement(spark, sf_dir), path, ["line_no"], header=True)
        return path

    return _memo(spark, sf_dir, "statement_files", build)


def printed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty statements under the names as printed, with their file."""
    return dirty_statement(spark, sf_dir).select(
        F.concat(F.lit(STATEMENT_PREFIX), "statement_id", F.lit(".csv")).alias("source_file"), "line_no",
        *[F.col(c).alias(h) for c, h in zip(["date", "particulars", "vch_type", "vch_no", "debit", "credit"], PAGE_HEADER)],
    )


def statement_bundles(spark: SparkSession, sf_dir: str) -> str:
    """The files of ``statement_files`` in bundles."""
    from ..sources.files import write_bundles
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "statement_bundles")
        write_bundles(printed_statement(spark, sf_dir), path, ["line_no"], header=True)
        return path

    return _memo(spark, sf_dir, "statement_bundles", build)


def mixed_statement_bundles(spark: SparkSession, sf_dir: str) -> str:
    """The dirty statements as one CSV per party, in bundles, each with its own header line: columns in the usual order, with credit before debit and the date
    last, or with a column more between them."""
    from ..sources.files import write_bundles
    from ..session import scratch_path

    def build():
        names = ["date", "particulars", "vch_type", "vch_no", "debit", "credit"]
        printed = dict(zip(names, PAGE_HEADER)) | {"extra": "Remarks "}
        orders = [[*names], ["particulars", "vch_type", "vch_no", "credit", "debit", "date"], ["date", "extra", "particulars", "vch_type", "vch_no", "debit", "credit"]]
        d = dirty_statement(spark, sf_dir).withColumn("extra", F.lit("Cr"))
        k = F.substring(F.col("statement_id"), -9, 9).cast("long") % 3
        cols = [f"_c{i}" for i in range(7)]
        file = F.concat(F.lit(STATEMENT_PREFIX), "statement_id", F.lit(".csv")).alias("source_file")

        def placed(order, value):
            return [value(c).alias(t) for c, t in zip(order, cols)] + [F.lit(None).cast("string").alias(t) for t in cols[len(order):]]

        parts = []
        for i, order in enumerate(orders):
            mine = d.where(k == i)
            parts.append(mine.select("statement_id").distinct().select(file, F.lit(0).cast("long").alias("line"), *placed(order, lambda c: F.lit(printed[c]))))
            parts.append(mine.select(file, F.col("line_no").alias("line"), *placed(order, F.col)))
        lines = parts[0]
        for more in parts[1:]:
            lines = lines.unionByName(more)
        path = scratch_path(spark, "mixed_statement_bundles")
        write_bundles(lines, path, ["line"])
        return path

    return _memo(spark, sf_dir, "mixed_statement_bundles", build)


def split_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty statements with their party, those of every seventh party in two: statement_id, line_no, customer_name and the text columns. The second
    begins at the first entry with a date from line 4 on."""

    def build():
        d = dirty_statement(spark, sf_dir)
        entry = (F.col("vch_type") == "Sale ") & (F.trim("date") != "") & (F.col("line_no") >= 4)
        cut = d.groupBy("statement_id").agg(F.min(F.when(entry, F.col("line_no"))).alias("cut"))
        d = join_per_key(d, cut, "statement_id", name="fx_cut")
        k = F.substring(F.col("statement_id"), -9, 9).cast("long")
        second = (k % 7 == 3) & F.col("cut").isNotNull() & (F.col("line_no") >= F.col("cut"))
        return d.select(
            F.concat("statement_id", F.when(second, F.lit("/2")).otherwise(F.lit("/1"))).alias("new_id"),
            F.when(second, F.col("line_no") - F.col("cut") + 1).otherwise(F.col("line_no")).alias("line_no"), F.col("statement_id").alias("customer_name"),
            "date", "particulars", "vch_type", "vch_no", "debit", "credit",
        ).withColumnRenamed("new_id", "statement_id")

    return _memo(spark, sf_dir, "split_statement", build)


def printed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one sheet per party from the own ledger: a title line, the header line (with a column more than needed), then the entries.

    Dates are written in one way per sheet: 1995-03-04, 4/3/1995, 04-Mar-1995, or the first with every seventh as 04.03.1995."""
    from ..schemas import SHEET_HEADER

    own = own_ledger(spark, sf_dir)
    cols = [f"_c{i}" for i in range(len(SHEET_HEADER) + 1)]
    name = F.concat(F.lit(SHEET_PREFIX), F.col("customer_name"), F.lit(".csv")).alias("source_file")
    parties = own.select("customer_name").distinct()
    title = parties.select(name, F.lit(1).cast("long").alias("line"), F.concat(F.lit("Ledger of "), "customer_name").alias(cols[0]),
                           *[F.lit(None).cast("string").alias(c) for c in cols[1:]])
    header = parties.select(name, F.lit(2).cast("long").alias("line"), *[F.lit(h).alias(c) for h, c in zip([*SHEET_HEADER, "Remarks"], cols)])
    money = lambda c: F.format_number(F.col(c), 2)
    way = F.regexp_extract("customer_name", r"(\d{9})", 1).cast("long") % 4
    way = F.when((way == 3) & (F.col("idx") % 7 == 0), F.lit(4)).otherwise(way)
    written = lambda f: F.date_format("posting_date", f)
    day = F.when(way == 1, written("d/M/yyyy")).when(way == 2, written("dd-MMM-yyyy")).when(way == 4, written("dd.MM.yyyy")).otherwise(written("yyyy-MM-dd"))
    origin_no = F.when(F.col("idx") % 3 == 0, F.concat("origin_no", F.lit(".0"))).otherwise(F.col("origin_no"))
    values = [day, day, F.col("idx").cast("string"), F.lit(SHEET_CONSTANTS["offset_account"]), F.lit(SHEET_CONSTANTS["origin"]),
              origin_no, F.lit(None).cast("string"), F.lit(SHEET_CONSTANTS["details"]), money("debit_lc"), money("credit_lc"),
              money("cumulative_balance_lc"), money("cumulative_balance_lc"), F.lit(SHEET_CONSTANTS["created_by"]),
              F.lit(SHEET_CONSTANTS["branch"]), F.lit("-")]
    data = own.select(name, (F.col("idx") + 2).alias("line"), *[v.alias(c) for v, c in zip(values, cols)])
    return title.unionByName(header).unionByName(data)


def sheet_files(spark: SparkSession, sf_dir: str) -> str:
    """The sheets as one CSV per party."""
    from ..sources.files import write_files
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "sheet_files")
        write_files(printed_sheets(spark, sf_dir), path, ["line"])
        return path

    return _memo(spark, sf_dir, "sheet_files", build)


def sheet_bundles(spark: SparkSession, sf_dir: str) -> str:
    """The sheets in bundles."""
    from ..sources.files import write_bundles
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "sheet_bundles")
        write_bundles(printed_sheets(spark, sf_dir), path, ["line"])
        return path

    return _memo(spark, sf_dir, "sheet_bundles", build)


# ---------------------------------------------------------------- OCR blocks (FIXTURES §6)

LINES_PER_PAGE = 10
# Pages of a file of responses, which are compressed and so read by one task each (about 15 KB a page unpacked)
PAGES_PER_FILE = 8192


def write_responses(documents: DataFrame, path: str) -> None:
    """Responses (``value``) as compressed text, one a line."""
    documents.select("value").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_FILE).text(path)


def _page_no():
    return (F.floor((F.col("line_no") - 1) / LINES_PER_PAGE) + 1).cast("int")


def page_lines(spark: SparkSession, sf_dir: str, lost: DataFrame | None = None) -> DataFrame:
    """The dirty statements by page: statement_id, page_no, lines (row, conf, texts; null for a cover page), without the pages ``lost`` by statement_id, page_no.

    One table per page (row 1 = header, where the page has one, and an empty 7th header cell, data rows with an 'x' in column 7); every tenth party has a
    cover page 0 without a table."""
    d = dirty_statement(spark, sf_dir)
    row = ((F.col("line_no") - 1) % LINES_PER_PAGE + 2).cast("int")
    line = F.struct(
        row.alias("row"), (F.lit(90) + F.col("line_no") % 10).cast("double").alias("conf"),
        F.array("date", "particulars", "vch_type", "vch_no", "debit", "credit", F.lit("x")).alias("texts"),
    )
    # the lines are dealt out by page as they are; their blocks, many times their size, are made in place when the responses are written
    pages = d.groupBy("statement_id", _page_no().alias("page_no")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    if lost is not None:
        # here, where the pages are dealt out by the keys of this join, they are not shuffled again for it
        pages = pages.join(lost, ["statement_id", "page_no"], "left_anti")
    # later pages of every third statement have no header, and those of the next a misread one
    k = F.substring(F.col("statement_id"), -9, 9).cast("long")
    later = F.col("page_no") >= 2
    names = [F.when((k % 3 == 1) & later, F.lit("Vch No ")).otherwise(F.lit(h)) if h == "Vch No. " else F.lit(h) for h in PAGE_HEADER]
    header = F.array(F.struct(F.lit(1).alias("row"), F.lit(90.0).alias("conf"), F.array(*names, F.lit("")).alias("texts")))
    pages = pages.withColumn("lines", F.when(~((k % 3 == 0) & later), F.concat(header, "lines")).otherwise(F.col("lines")))
    covers = d.where((F.col("line_no") == 1) & (k % 10 == 0)).select("statement_id", F.lit(0).alias("page_no"), F.lit(None).cast(pages.schema["lines"].dataType).alias("lines"))
    return pages.unionByName(covers)


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty statements as a table-extraction service returns them: one row per page (``page_lines``) with its blocks.

    One TABLE per page, CELL and WORD blocks, empty cells without children; a cover page has a PAGE block alone."""

    def build():
        blocks = F.from_json("value", T.StructType([OCR_PAGE["Blocks"]]))["Blocks"]
        return responses(page_lines(spark, sf_dir)).select("statement_id", "page_no", blocks.alias("Blocks"))

    return _memo(spark, sf_dir, "ocr_pages", build)


def ocr_files(spark: SparkSession, sf_dir: str) -> str:
    """The OCR responses written as JSON documents (one per page) under the checkpoint folder."""
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "ocr_json")
        pages = page_lines(spark, sf_dir)
        write_responses(responses(pages), path)
        # a response cut off in transfer for every tenth statement
        k = F.substring(F.col("statement_id"), -9, 9).cast("long")
        cut = pages.where((k % 10 == 3) & (F.col("page_no") == 1)).select(F.concat(F.lit('{"statement_id": "'), "statement_id", F.lit('", "page_no": 99, "Blocks": [{"Id"')))
        cut.write.mode("append").text(path)
        return path

    return _memo(spark, sf_dir, "ocr_files", build)


def lost_page(k, page_no, last_page):
    """Pages that never arrive in the redelivered responses: the second page of every seventh statement that has a third."""
    return (k % 7 == 2) & (page_no == 2) & (last_page > 2)


def ocr_redelivered_files(spark: SparkSession, sf_dir: str) -> str:
    """The OCR responses as a queue delivers them: with their time of arrival, every tenth page first in another form (each word misread), every
    tenth twice alike, and some pages lost."""
    from ..session import scratch_path

    def build():
        # which pages are lost is told by their keys, before there are blocks: those are never shuffled
        k = F.substring(F.col("statement_id"), -9, 9).cast("long")
        second = F.max(F.when(_page_no() == 2, _page_no()))  # a column, as a literal would leave the join with the statement alone for its key
        last = dirty_statement(spark, sf_dir).groupBy("statement_id").agg(F.max(_page_no()).alias("last_page"), second.alias("page_no"))
        lost = last.where(lost_page(k, F.col("page_no"), F.col("last_page"))).select("statement_id", "page_no")
        pages = page_lines(spark, sf_dir, lost).where(F.col("statement_id").isNotNull())
        turn = (k + F.col("page_no")) % 10
        path = scratch_path(spark, "ocr_redelivered")
        pages = pages.withColumns({"misread": turn == 0, "again": turn == 5})
        write_responses(deliveries(pages, once="2024-04-02T10:00:00Z", before="2024-04-01T10:00:00Z"), path)
        return path

    return _memo(spark, sf_dir, "ocr_redelivered", build)
