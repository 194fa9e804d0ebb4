"""Benchmark: headline queries of the catalogue on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit", "queries", "sf", ...}.
Inputs (the two books per party, the OCR'd statements) are derived once and
timed as ``inputs``; each query is then run cold to completion with the
``noop`` sink (every row computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "gold_entries",      # flagship: verdict + unmatched entries of every party
    "recon_messages",    # verdict messages with entry counts
    "balance_verdict",
    "gold_case4",        # the anti-join matching of diverged parties
    "running_balance",
    "silver_entries",    # statement text -> silver with running balance
    "closing_check",
    "ocr_rows",          # OCR blocks -> statement rows
    "ocr_to_gold",       # the whole flow: OCR blocks -> bronze -> silver -> reconciliation
    "name_resolve",
    "max_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE

    from ledgerloom.plans import catalogue
    from ledgerloom.plans import fixtures as fx
    from ledgerloom.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="ledgerloom-bench")

    def run(df) -> None:
        df.write.mode("overwrite").format("noop").save()

    t0 = time.time()
    fx.own_ledger(spark, sf_dir)
    fx.counterparty_statement(spark, sf_dir)
    fx.dirty_statement(spark, sf_dir)
    fx.ocr_files(spark, sf_dir)
    inputs_s = time.time() - t0

    times: dict[str, float] = {}
    for name in only:
        catalogue.forget()  # every query pays for its own tables; only the inputs are shared
        t = time.time()
        run(catalogue.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "inputs_sec": round(inputs_s, 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
