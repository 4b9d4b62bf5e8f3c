"""Readers: Parquet tables, CSV, JSON and text with the null rules of this engine, word boxes, file listings, zip and tar archives."""
