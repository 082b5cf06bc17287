"""Sources and sinks: the Parquet ledger store, the test tables, sample files."""
