"""Scans and sinks: parquet tables, all-text CSV, paired train/test reads."""
