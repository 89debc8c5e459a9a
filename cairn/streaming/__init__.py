"""Continuous ingestion of snapshots."""
