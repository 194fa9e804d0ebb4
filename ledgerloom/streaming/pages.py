"""R0-R2 over OCR pages that arrive in any order: a stream of pages to silver entries, by state per statement.

Two keyed states follow each other in one query:

* ``Layout`` keeps, per statement, the next page it waits for, the lines so far and where the columns are. A page that comes early is held (its rows as one
  text, so Python never looks into them) until the gap before it is filled; then all pages in a row leave with their place. The rules are those of
  ``operators.ocr.laid_out``.
* The rows are unpacked and cleaned to bronze by the batch's own expressions.
* ``Book`` keeps the last date, the number of lines and the balance, and carries them through the lines that left the first state, which are always
  the ones that follow (W3, F2, F3, W1, W4).

State per statement: a few values and the pages held. Work per statement and micro-batch: the pages that arrived and those they set free, bounded by
``max_files_per_trigger`` and the gap; a statement of any length is never read again.

Defined results: pages count from ``first_page``; one with a lower number (a cover) is never waited for, and goes first if it arrives before the first page has left. Of a page that arrives
again while it is held the last response counts, as in the batch; one whose lines have left, or a cover that is too late, is a reject, as lines that are out can't change. A page before any header is a reject if it has rows. A page behind a
gap stays held until the gap is filled (``page_gaps`` of a batch lists gaps). Each statement is a book of its own; several statements of a party are joined to one by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ocr, silver
from ..operators.blocks import ROWS
from ..operators.bronze import to_bronze
from ..schemas import BRONZE_COLUMNS, MONEY, SILVER
from ..session import scratch_path
from ..sources.ocr import stream_ocr_pages

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Why a page has no lines
LATE = "delivered after its place was taken"
NO_HEADER = "no header on this page or before"

_PAGE = "arrival timestamp, content bigint, named array<int>, blank array<int>, width int, n int, rows string"
_PLACED = "statement_id string, page_no int, reason string, own boolean, at array<int>, before bigint, rows string"
# A reject goes on as one line without content.
_NO_LINE = (False, [0] * len(BRONZE_COLUMNS), 0, '[{"table_no":0,"row_index":0,"cells":[]}]')
_ENTRY = T.StructType([T.StructField("statement_id", T.StringType()), *SILVER.fields, T.StructField("page_no", T.IntegerType()), T.StructField("reason", T.StringType())])


def _ints(x) -> list[int] | None:
    return None if x is None else [int(i) for i in x]


class Layout(StatefulProcessor):
    """Pages of a statement in their order, with the place of their columns and the lines before them."""

    def __init__(self, first_page: int) -> None:
        self.first_page = first_page

    def init(self, handle: StatefulProcessorHandle) -> None:
        # unnamed: the places that the statement's first full header leaves blank; null until there is one
        self.seen = handle.getValueState("seen", "next int, lines bigint, unnamed array<int>, carried array<int>")
        self.held = handle.getMapState("held", "page int", _PAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.seen.get() if self.seen.exists() else (self.first_page, 0, None, None)
        next_page, lines, unnamed, carried = int(state[0]), int(state[1]), _ints(state[2]), _ints(state[3])
        started = next_page > self.first_page
        out = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                page = int(r.page_no)
                if started and page < next_page:
                    out.append((key[0], page, LATE, *_NO_LINE))
                    continue
                new = (r.arrival.to_pydatetime(), int(r.content), _ints(r.named), _ints(r.blank), int(r.width), int(r.n), r.rows)
                old = self.held.getValue((page,)) if self.held.containsKey((page,)) else None
                if old is None or (_time(old[0]), old[1]) < (_time(new[0]), new[1]):
                    self.held.updateValue((page,), new)
        free = []
        if self.held.containsKey((next_page,)) and not started:
            free = sorted(k[0] for k in self.held.keys() if k[0] < next_page)
        while self.held.containsKey((next_page,)):
            free.append(next_page)
            next_page += 1
        for page in free:
            _, _, named, blank, width, n, packed = self.held.getValue((page,))
            self.held.removeKey((page,))
            named, blank = _ints(named), _ints(blank)
            full = named is not None and 0 not in named
            own = named is not None and (unnamed is None or all(b > width or b in blank for b in unnamed))
            if full and unnamed is None:
                unnamed = blank
            if own and full:
                carried = named
            at = [c if x == 0 else x for x, c in zip(named, carried or named)] if own else carried
            body = n - own
            if at is None:
                if body:
                    out.append((key[0], page, NO_HEADER, *_NO_LINE))
                continue
            out.append((key[0], page, None, own, at, lines, packed))
            lines += body
        self.seen.update((next_page, lines, unnamed, carried))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _PLACED.split(", ")])


def _time(t) -> float:
    return pd.Timestamp(t).timestamp()


class Book(StatefulProcessor):
    """Lines of a statement that follow those before: date filled, earlier years and page headers left out, numbered, with the running balance."""

    def __init__(self, fiscal_start: str) -> None:
        self.start = pd.Timestamp(fiscal_start).date()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("date", T.DateType()), T.StructField("lines", T.LongType()), T.StructField("balance", MONEY)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows), ignore_index=True)
        names = [f.name for f in _ENTRY.fields]
        rejects = lines[lines["reason"].notna()]
        if len(rejects):
            yield rejects.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
        lines = lines[lines["reason"].isna()].sort_values("line_no")
        if not len(lines):
            return
        date, count, balance = self.seen.get() if self.seen.exists() else (None, 0, 0)
        filled = lambda before, d: before if pd.isna(d) else d
        dates = list(accumulate(chain([date], lines["date"]), filled))[1:]
        lines["posting_date"] = pd.Series(dates, lines.index, object)
        keep = np.array([d is not None and d >= self.start for d in dates]) & ~lines["heads"].to_numpy(bool)
        lines = lines[keep]
        if len(lines):
            balances = list(accumulate(lines["value"], initial=balance))[1:]
            lines = lines.assign(idx=range(int(count) + 1, int(count) + 1 + len(lines)), cumulative_amount_in_local_currency=balances)
            count, balance = int(count) + len(lines), balances[-1]
            yield lines.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
        self.seen.update((dates[-1], int(count), balance))


def silver_stream(pages: DataFrame, fiscal_start: str, first_page: int = 1) -> DataFrame:
    """Silver entries (with statement_id, page_no; reason null) and rejected pages (with reason) of a stream of OCR pages."""
    spark = pages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # maps in a state need it
    arrival = F.coalesce("arrival", F.lit(0).cast("timestamp"))
    slim = ocr.summarised(pages.withColumn("_arrival", arrival)).select(
        *ocr.PAGE, F.col("_arrival").alias("arrival"), F.coalesce("_content", F.lit(0)).alias("content"), F.col("_named").alias("named"),
        F.coalesce("_blank", F.array().cast("array<int>")).alias("blank"), F.greatest(F.col("_width"), F.lit(0)).alias("width"),
        F.greatest(F.col("_n"), F.lit(0)).alias("n"), F.coalesce(F.to_json("_rows"), F.lit("[]")).alias("rows"),
    )
    placed = slim.groupBy("statement_id").transformWithStateInPandas(Layout(first_page), _PLACED, "Append", "None")
    placed = placed.select(*ocr.PAGE, "reason", F.from_json("rows", ROWS).alias("_rows"), F.col("own").alias("_own"), F.col("at").alias("_at"), F.col("before").alias("_before"))
    raw = ocr.page_lines(placed, "reason").select("statement_id", "line_no", *BRONZE_COLUMNS, "page_no", "reason")
    lines = to_bronze(raw, keep=["page_no", "reason"])
    lines = lines.where(F.col("reason").isNotNull() | ~silver.is_blank_line(F.col("date"), F.col("vch_no"), F.col("vch_type")))
    zero = F.lit(0).cast(MONEY)
    lines = lines.select(
        "statement_id", "customer_name", "line_no", "date", "particulars", F.col("vch_type").alias("voucher_type"), F.col("vch_no").alias("voucher_number"),
        F.col("debit").alias("debit_amount_in_local_currency"), F.col("credit").alias("credit_amount_in_local_currency"),
        (F.coalesce("credit", zero) - F.coalesce("debit", zero)).cast(MONEY).alias("value"),
        F.coalesce(silver.is_page_header(F.col("particulars"), F.col("vch_no"), F.col("vch_type")), F.lit(False)).alias("heads"), "page_no", "reason",
    )
    return lines.groupBy("statement_id").transformWithStateInPandas(Book(fiscal_start), _ENTRY, "Append", "None")


def start_page_stream(
    spark: SparkSession, folder: str, out: str, fiscal_start: str, *, first_page: int = 1, checkpoint: str | None = None, available_now: bool = True, max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Start the stream over a folder of OCR responses. Each micro-batch overwrites its own ``epoch=<id>`` folder below ``out``, so one that is tried again replaces
    its output; ``read_entries`` and ``read_rejects`` read them."""
    entries = silver_stream(stream_ocr_pages(spark, folder, max_files_per_trigger), fiscal_start, first_page)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(f"{out}/epoch={epoch}")

    writer = entries.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint or scratch_path(spark, "page_stream"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _read(spark: SparkSession, out: str) -> DataFrame:
    schema = T.StructType([*_ENTRY.fields, T.StructField("epoch", T.LongType()), T.StructField("rejected", T.BooleanType())])
    return spark.read.schema(schema).parquet(out)


def read_entries(spark: SparkSession, out: str) -> DataFrame:
    """The silver entries that have left the stream so far, as ``silver.to_silver`` gives them."""
    return _read(spark, out).where("NOT rejected").select(*SILVER.names, "statement_id")


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """(statement_id, page_no, reason) of pages that gave no lines."""
    return _read(spark, out).where("rejected").select("statement_id", "page_no", "reason")
