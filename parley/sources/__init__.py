"""Scans and sinks: parquet test tables, raw dialogue CSV, split/parameter JSON, file presence."""
