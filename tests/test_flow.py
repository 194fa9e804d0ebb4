"""The documented flow from files: OCR JSON -> silver, ledger sheets -> ledger, reconcile, append gold, messages."""

from pyspark.sql import types as T

from ledgerloom.operators import bronze, ledger, ocr, reconcile, silver
from ledgerloom.plans import fixtures as fx
from ledgerloom.schemas import SHEET_HEADER
from ledgerloom.session import scratch_path
from ledgerloom.sources import files, sinks
from ledgerloom.sources import ocr as ocr_source

from conftest import SF_SMALL


def test_files_to_gold(spark):
    pages = ocr_source.read_ocr_pages(spark, fx.ocr_files(spark, SF_SMALL))
    stmt = silver.to_silver(bronze.to_bronze(ocr.statement_rows(pages)), fx.FISCAL_START)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(SHEET_HEADER))])
    sheet = ledger.to_ledger(files.read_files(spark, fx.sheet_files(spark, SF_SMALL), schema=schema))
    rec = reconcile.reconcile(sheet, stmt, fx.FISCAL_START)
    out = scratch_path(spark, "gold_flow")
    sinks.append_gold(rec.gold(), out, "run-1")
    assert sinks.read_gold(spark, out, "run-1").count() == 280
    counts = {r["verdict"]: r["count"] for r in rec.messages().groupBy("verdict").count().collect()}
    assert counts == {"balanced": 15, "extra_in_own": 32, "extra_in_counterparty": 30, "diverged": 43, "opening_differs": 30}
