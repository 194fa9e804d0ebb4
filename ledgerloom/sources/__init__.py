"""Sources and sinks: per-party statement and sheet files, OCR responses, bronze/gold/report tables."""
