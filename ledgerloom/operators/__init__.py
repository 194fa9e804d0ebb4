"""DataFrame operators: skew-safe ordered scans, checked joins, OCR rebuild, bronze, silver, ledger, names, reconciliation."""
