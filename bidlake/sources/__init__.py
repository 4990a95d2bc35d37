"""Sources and sinks: parquet, partitioned parquet, CSV, staged intermediates."""
