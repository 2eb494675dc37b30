"""Declared schemas, readers (parquet/CSV/JDBC), sinks (parquet, TSV) and the
test-data proxies."""
