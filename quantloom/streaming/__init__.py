"""Continuous ingest into the partitioned store."""
