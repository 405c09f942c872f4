"""Readers and writers for mail corpora and snapshots."""
