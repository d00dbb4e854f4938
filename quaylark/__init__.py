"""Posting analytics on Spark: ingest, extract, publish and query continuously collected listings."""
