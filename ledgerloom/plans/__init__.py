"""Query catalogue over the testdata: fixtures derived by Spark, one query per operator, independent DuckDB oracles."""
