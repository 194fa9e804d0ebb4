"""ledgerloom: ledger reconciliation as Spark DataFrame plans.

Two books of the same trading relationship (the own ERP ledger and the
counterparty's statement, recovered from OCR table blocks) are cleaned,
given running balances, and reconciled per party in one distributed pass.
"""

__version__ = "0.1.0"
